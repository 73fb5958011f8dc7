"""Exact stratified splitting.

Rows are ordered inside each stratum by a seeded hash, and the split points are
ranks in that order. Counts per hash bucket tell in which bucket a split point
falls and only such buckets are sorted; every row is then labelled by comparing
its (hash, id) with the split points of its stratum, a narrow step. The table is
read twice, once for ids and strata only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from scoreloom.functions.hashing import BITS, row_draw
from scoreloom.session import settle, written

SEED = 42
# Top bits of the hash that name a bucket.
BUCKET_BITS = 12


def _take_share(counts: DataFrame, stratum: str, share: float) -> DataFrame:
    """Add ``size``: the part of each stratum's ``n`` rows that goes to one side.

    That side has floor(share * rows) rows in total. Each stratum gives the
    whole part of its proportional share; the rows left over come from the
    strata with the largest remainders (the first stratum on ties). The
    windows see one row per stratum.
    """
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_remainder = W.orderBy(F.desc("_remainder"), F.asc(stratum))

    def times(a: str, b: str) -> Column:
        # Products of two row counts do not fit into 64 bits at full scale.
        return F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")

    return (counts
            .withColumn("_all", F.sum("n").over(every))
            .withColumn("_target", F.floor(F.lit(share) * F.col("_all") + F.lit(1e-9)))
            .withColumn("_product", times("n", "_target"))
            .withColumn("_whole", F.coalesce(F.try_divide(
                F.col("_product") - F.expr("_product % nullif(_all, 0)"), F.col("_all")).cast("bigint"),
                F.lit(0)))
            .withColumn("_remainder", F.col("_product") - times("_whole", "_all"))
            .withColumn("_left", F.col("_target") - F.sum("_whole").over(every))
            .withColumn("size", F.col("_whole") + F.when(
                F.row_number().over(by_remainder) <= F.col("_left"), 1).otherwise(0))
            .drop("_all", "_target", "_product", "_whole", "_remainder", "_left"))


def nested_sizes(counts: DataFrame, stratum: str, keep: Sequence[float]) -> DataFrame:
    """(stratum, n, cuts): cumulative split points of successive two-way splits.

    ``keep[i]`` is the share kept by part i of what parts 0..i-1 left over, so
    (0.7, 0.5) is a 70/15/15 split made in two steps.
    """
    sized = counts.select(
        stratum, F.col("n").cast("bigint").alias("n"), F.col("n").cast("bigint").alias("_total"),
        F.array().cast("array<bigint>").alias("cuts"))
    for share in keep:
        rest = _take_share(sized, stratum, share).withColumn("n", F.col("n") - F.col("size"))
        sized = rest.withColumn("cuts", F.array_append("cuts", F.col("_total") - F.col("n"))).drop("size")
    return sized.select(stratum, F.col("_total").alias("n"), "cuts")


def split_points(df: DataFrame, stratum: str, keep: Sequence[float], row_id: str,
                 seed: int = SEED, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(stratum, marks): per split point the (hash, id) of the last row before it.

    The hash is even, so its top bits cut a stratum into small buckets. Counts
    per bucket give the strata's sizes and the bucket of every split point;
    only the rows of those buckets are put in order.
    """
    # Written once: what follows reads three narrow columns, whatever made the table.
    keyed = written(df.select(F.col(stratum), row_draw(df, row_id, seed).alias("v"), F.col(row_id).alias("tie")), "keyed")
    bucket = F.shiftright("v", BITS - bucket_bits).cast("int")
    counts = settle(keyed.groupBy(stratum, bucket.alias("bucket")).agg(F.count("*").alias("c")))
    sizes = nested_sizes(counts.groupBy(stratum).agg(F.sum("c").alias("n")), stratum, keep)
    upto = F.sum("c").over(W.partitionBy(stratum).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    wanted = sizes.select(stratum, F.posexplode("cuts").alias("mark", "rank")).where(F.col("rank") > 0)
    edges = settle(counts.withColumn("upto", upto).join(wanted, stratum)
                   .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
                   .select(stratum, "bucket", "mark", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")))
    order = W.partitionBy(stratum, "bucket").orderBy("v", "tie")
    # The buckets of a stratum travel as one array: a few per split point.
    wants = edges.groupBy(stratum).agg(F.collect_list(F.struct("bucket", "mark", "rank")).alias("edges"))
    inside = (keyed.join(wants, stratum)
              .where(F.exists("edges", lambda e: e["bucket"] == F.shiftright("v", BITS - bucket_bits)))
              .withColumn("bucket", bucket).withColumn("place", F.row_number().over(order)))
    marks = (inside.select(stratum, "bucket", "place", "v", "tie", F.inline("edges").alias("of", "mark", "rank"))
             .where((F.col("of") == F.col("bucket")) & (F.col("place") == F.col("rank"))).groupBy(stratum)
             .agg(F.map_from_entries(F.collect_list(F.struct("mark", F.struct("v", "tie")))).alias("marks")))
    return settle(marks)


def stratified_split(df: DataFrame, stratum: str, keep: Sequence[float],
                     names: Sequence[str], row_id: str = "row_id", seed: int = SEED,
                     bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Add a ``split`` column naming the part of every row.

    Every row with a stratum lands in exactly one part; a row without one keeps
    a NULL split. ``row_id`` is expected to be unique; rows that share an id
    stay together, which can move a part's size by the repetitions.
    """
    if len(names) != len(keep) + 1:
        raise ValueError("one more name than split points is needed")
    marks = split_points(df.where(F.col(stratum).isNotNull()), stratum, keep, row_id, seed, bucket_bits)
    place = F.struct(row_draw(df, row_id, seed).alias("v"), F.col(row_id).alias("tie"))
    part = F.lit(names[-1])
    for cut in reversed(range(len(keep))):
        part = F.when(place <= F.col("marks")[cut], F.lit(names[cut])).otherwise(part)
    part = F.when(F.col(stratum).isNotNull(), part)
    return df.join(marks, stratum, "left").withColumn("split", part).drop("marks")


def split_sizes(split: DataFrame, stratum: str) -> DataFrame:
    """Rows per part and stratum."""
    return split.groupBy("split", stratum).agg(F.count("*").alias("n"))


# Shares of the successive two-way splits of the two trainers.
THREE_WAY: Mapping[str, Sequence] = {"keep": (0.7, 0.5), "names": ("train", "val", "test")}
TWO_WAY: Mapping[str, Sequence] = {"keep": (0.9,), "names": ("train", "val")}
