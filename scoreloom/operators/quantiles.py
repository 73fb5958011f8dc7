"""Exact interpolated quantiles per group, for any number of rows and values.

Two passes. The first takes an approximate percentile a little below and a
little above every wanted rank, which brackets the rank; the bracket of a small
group is all of it. The second counts the rows below each bracket and, inside
it, the rows per value. A bracket is cut into ``STEPS`` ranges of values; sums
over the ranges tell which of them hold a rank, and only their values are put
in order. Percentiles are off by at most one row in ``ACCURACY`` and brackets
reach two rows in ``ACCURACY`` further out, so from ``SMALL`` rows on they hold
their ranks. The counts prove it; should a bracket miss all the same, that
quantile is found by narrowing ranges (``ranked_rows``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from scoreloom.operators.ranks import RANK_ROWS, first_regions, logarithmic, ranked_rows
from scoreloom.session import settle, written

ACCURACY = 20_000
SMALL = 4 * ACCURACY        # rows of a group that is put in order as it is
STEPS = 1024                # ranges of a bracket


def _rows(df: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(F.col(by), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & F.col(by).isNotNull())


def _spots(n: Column, probs: Sequence[float]) -> list[Column]:
    """Ranks from 0, with a fraction where two rows are interpolated."""
    return [(n - 1) * F.lit(float(q)) for q in probs]


def exact_quantiles(df: DataFrame, by: str, value: str, probs: Sequence[float],
                    rank_rows: int = RANK_ROWS, accuracy: int = ACCURACY, small: int = SMALL,
                    steps: int = STEPS) -> DataFrame:
    """(by, quantiles): linearly interpolated quantiles, in the order of ``probs``."""
    rows = _rows(df, by, value)
    sides = sorted({min(max(q + s * 2.0 / accuracy, 0.0), 1.0) for q in probs for s in (-1, 1)})
    groups = settle(rows.groupBy(by).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.percentile_approx("v", sides, F.lit(accuracy)).alias("sides")))

    def side(q: float, s: int) -> Column:
        return F.col("sides")[sides.index(min(max(q + s * 2.0 / accuracy, 0.0), 1.0))]

    brackets = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.floor(spot) + 1).alias("first"), (F.ceil(spot) + 1).alias("last"),
                 F.when((F.col("n") <= small) | (spot < 1), F.col("low")).otherwise(side(q, -1)).alias("from"),
                 F.when((F.col("n") <= small) | (spot >= F.col("n") - 2), F.col("high")).otherwise(side(q, 1)).alias("to"))
        for i, (q, spot) in enumerate(zip(probs, _spots(F.col("n"), probs)))])
    wanted = groups.select(by, brackets.alias("brackets"))

    # Counts below brackets and per value inside; every other row adds to counts only.
    # A row is a value inside of some bracket, or the mark of how many brackets are above it.
    def below(i: int) -> Column:
        return F.count_if(F.col("v") < F.col("brackets")[i]["from"]).alias(f"below{i}")

    inside = F.exists("brackets", lambda b: (F.col("v") >= b["from"]) & (F.col("v") <= b["to"]))
    counted = (rows.join(wanted, by)
               .groupBy(by, F.when(inside, F.col("v")).alias("v"))
               .agg(F.count("*").alias("c"), *[below(i) for i in range(len(probs))]))
    counted = written(counted, "inside")
    lower = counted.groupBy(by).agg(*[F.sum(f"below{i}").alias(f"below{i}") for i in range(len(probs))])
    spread = (counted.where(F.col("v").isNotNull()).select(by, "v", "c")
              .join(wanted.select(by, F.inline("brackets")), by)
              .where((F.col("v") >= F.col("from")) & (F.col("v") <= F.col("to"))))
    place = F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * steps)
    spread = spread.withColumn("step", F.when(F.col("to") > F.col("from"), F.least(place, F.lit(steps - 1))).otherwise(0))
    under = F.element_at(F.array(*[F.col(f"below{i}") for i in range(len(probs))]), F.col("i") + 1)
    total = F.sum("rows").over(W.partitionBy(by, "i").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow))
    holding = (spread.groupBy(by, "i", "step", "first", "last").agg(F.sum("c").alias("rows"))
               .withColumn("ahead", total - F.col("rows")).join(lower, by).withColumn("ahead", F.col("ahead") + under)
               .where((F.col("ahead") < F.col("last")) & (F.col("ahead") + F.col("rows") >= F.col("first")))
               .select(by, "i", "step", "ahead"))
    upto = F.sum("c").over(W.partitionBy(by, "i", "step").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("ahead")
    ranked = (spread.join(holding, [by, "i", "step"]).withColumn("upto", upto)
              .select(by, "i", "v", "first", "last", "upto", (F.col("upto") - F.col("c")).alias("before")))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("before") < F.col(rank)) & (F.col(rank) <= F.col("upto")), F.col("v")))

    found = (ranked.groupBy(by, "i").agg(at("first").alias("a"), at("last").alias("b"))
             .groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("a", "b")))).alias("found")))

    def between(i: int, spot: Column) -> Column:
        a, b = F.col("found")[i]["a"], F.col("found")[i]["b"]
        return F.when(a == b, a).otherwise(a + (b - a) * (spot - F.floor(spot)))

    result = settle(groups.select(by, "n").join(found, by, "left").select(
        by, F.array(*[between(i, s) for i, s in enumerate(_spots(F.col("n"), probs))]).alias("quantiles")))
    missed = result.where(F.exists("quantiles", lambda q: q.isNull())).select(by)
    if missed.isEmpty():
        return result
    again = _ranked_quantiles(rows.join(missed, by), by, probs, rank_rows)
    return result.join(missed, by, "left_anti").unionByName(again)


def _ranked_quantiles(rows: DataFrame, by: str, probs: Sequence[float], rank_rows: int = RANK_ROWS) -> DataFrame:
    """The same by narrowing ranges; ``rows`` has (by, v)."""
    rows = rows.withColumn("tie", F.lit(0))
    spots = _spots(F.col("n"), probs)
    wants = F.array(*[
        F.struct(F.lit(2 * i + side).alias("mark"), (rounding(spot) + 1).alias("rank"))
        for i, spot in enumerate(spots) for side, rounding in enumerate((F.floor, F.ceil))])
    groups = settle(rows.groupBy(by).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    marks = ranked_rows(rows, first_regions(groups.withColumn("wants", wants), by), by,
                        scale=logarithmic, rank_rows=rank_rows)

    def at(mark: int):
        return F.col("marks")[mark]["v"]

    between = [at(2 * i) + (at(2 * i + 1) - at(2 * i)) * (spot - F.floor(spot))
               for i, spot in enumerate(spots)]
    return marks.join(groups.select(by, "n"), by).select(by, F.array(*between).alias("quantiles"))
