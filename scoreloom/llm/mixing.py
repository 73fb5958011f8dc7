"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is a number of equal blocks of words. Blocks go to sources by highest
quotients ``target / (2k + 1)``, then inside each source to its shards in the
same way, which gives every shard a whole-number quota. Inside a shard the
documents stand in a seeded order and the quota is taken from the front: whole
rounds over the shard first, then the beginning of the next round.

Quotients are not drawn one by one: rounding the exact share bounds the seats
of each party from both sides, and only quotients between the bounds are
ranked. That leaves a few rows per party, however many blocks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scoreloom.functions.hashing import draw
from scoreloom.llm.runtime import stored

BLOCK = 16                  # words
SHARD = 1 << 18             # words of a shard, about
REPEATS = 3                 # a source, a shard or a document is taken at most so often
WEIGHTS = (1, 2, 3)
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sid, source, source_size, weight and target of every source.

    One row per source from here on. Targets fill up by weight; a source that
    would pass ``repeats`` times its size stops there and the excess is shared
    by the others. In order of size to weight the stopped sources come first,
    so that running sums tell where stopping ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    named = per.select("source", "source_size", rank.alias("sid"), weight.alias("weight"),
                       (F.lit(float(repeats)) * F.col("source_size")).alias("most"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    zero = F.lit(0.0)
    run = named.select(
        "*", F.sum("source_size").over(everything).cast("double").alias("all"), F.sum("weight").over(everything).alias("w_all"),
        F.coalesce(F.sum("most").over(before), zero).alias("most_before"),
        F.coalesce(F.sum("weight").over(before), zero).alias("w_before"))
    level = (F.col("all") - F.col("most_before")) / (F.col("w_all") - F.col("w_before"))
    stop = F.col("most") / F.col("weight") <= level
    run = run.withColumn("stops", stop)
    stopped = F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(everything)
    w_stopped = F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(0.0)).over(everything)
    return run.select(
        "sid", "source", "source_size", "weight",
        F.when(F.col("stops"), F.col("most"))
        .otherwise(F.col("weight") * (F.col("all") - stopped) / (F.col("w_all") - w_stopped)).alias("target"))


def highest_quotients(parties: DataFrame, claim: str, limit: str, seats: str, within: str | None, name: str) -> DataFrame:
    """Seats of every party by highest quotients ``claim / (2k + 1)``.

    ``seats`` is the number of seats of the group (``within``, or of all),
    ``limit`` the most a party may take. Ties go to the smaller ``name``.
    """
    group = Window.partitionBy(within or F.lit(1))
    total, n = F.sum(claim).over(group), F.count(F.lit(1)).over(group)
    share = F.when(total > 0, F.col(claim) * F.col(seats) / total).otherwise(0.0)
    # Rounding every share moves their sum by half a seat per party at most.
    slack = n / (2.0 * F.greatest(F.col(seats), F.lit(1)))
    low = F.greatest(F.floor(share * (1 - slack) - 0.5) - 1, F.lit(0)).cast("long")
    high = (F.ceil(share * (1 + slack) + 0.5) + 1).cast("long")
    sized = parties.withColumn("low", F.least(low, F.col(limit)))
    sized = sized.withColumn("high", F.greatest(F.least(high, F.col(limit)), F.col("low")))
    sized = sized.withColumn("left", F.col(seats) - F.sum("low").over(group))
    open_seats = (sized.where((F.col("high") > F.col("low")) & (F.col("left") > 0))
                  .withColumn("k", F.explode(F.sequence(F.col("low"), F.col("high") - 1))))
    order = Window.partitionBy(within or F.lit(1)).orderBy(F.desc(F.col(claim) / (2 * F.col("k") + 1)), name, "k")
    keys = [within, name] if within else [name]
    won = (open_seats.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("left"))
           .groupBy(*keys).agg(F.count(F.lit(1)).alias("won")))
    return (sized.join(won, keys, "left")
            .withColumn("won", F.col("low") + F.coalesce("won", F.lit(0)))
            .drop("low", "high", "left"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = BLOCK,
                shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    ``size`` is the words of the text (NULL: 0) and ``taken`` the words of the
    document in the mix, repeats counted. The words taken from a source differ
    from its target by rounding to blocks only, and no document is taken more
    than ``repeats`` times its size. Sources count in code point order, NULL
    last, for their weights.

    A NULL doc_id is a document like others; documents that share a doc_id (or
    repeated rows) keep their own rows, in an order by size; among equal rows
    it does not matter which comes first. An empty table gives no rows; a
    source without words has target 0. Further columns are ignored.
    """
    sizes = stored(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size")), "sizes")
    targets = stored(source_targets(sizes, weights, repeats), "targets")
    # Number of shards of a source, from its size alone.
    shards = F.greatest(F.ceil(F.col("source_size") / F.lit(shard)), F.lit(1)).cast("long")
    rows = (sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]))
            .select("doc_id", sizes["source"], "size", "sid", "source_size", "target",
                    F.pmod(draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), shards).alias("shard")))
    seats = targets.withColumn("seats", F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / F.lit(block)).cast("long"))
    seats = seats.withColumn("limit", F.floor(F.lit(repeats) * F.col("source_size") / F.lit(block)).cast("long"))
    of_source = highest_quotients(seats, "target", "limit", "seats", None, "sid").select("sid", F.col("won").alias("source_seats"))
    parts = rows.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size")).join(of_source, "sid")
    parts = parts.withColumn("limit", F.floor(F.lit(repeats) * F.col("shard_size") / F.lit(block)).cast("long"))
    quota = highest_quotients(parts, "shard_size", "limit", "source_seats", "sid", "shard").select(
        "sid", "shard", "shard_size", (F.col("won") * F.lit(block)).alias("quota"))
    order = Window.partitionBy("sid", "shard").orderBy(
        draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed), word=1), "doc_id", "size")
    front = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.withColumn("front", front).join(quota, ["sid", "shard"])
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("quota") - whole * F.col("shard_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("front")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
