"""Order statistics of large groups: the row of a given rank, found exactly.

A sort or a per-group sketch would bring a large group into one task. Here the
range that holds the wanted rank is narrowed step by step: one aggregation
counts the rows of 4096 consecutive sub-ranges, and only the sub-range with
the rank is looked at again. Counts combine on the map side and their groups
spread over all tasks, so a group holding most of the table costs the same as
any other. When the remaining range is small its rows are put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from scoreloom.session import settle

STEPS = 4096
LEVELS = 6
# Ranges up to this many rows are put in order directly.
RANK_ROWS = 100_000


def logarithmic(v: Column) -> Column:
    """A monotone scale that keeps far outliers from crowding the other rows."""
    return F.signum(v) * F.log1p(F.abs(v))


def _step(scale: Callable[[Column], Column]) -> Column:
    """Sub-range of a value inside its range; monotone in the value."""
    low, high = scale(F.col("low")), scale(F.col("high"))
    share = F.try_divide(scale(F.col("v")) - low, high - low)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * STEPS), F.lit(STEPS - 1)).cast("int")


def _inside(rows: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """Rows that fall into one of the (disjoint) ranges of their group."""
    return (rows.join(regions, by).select(*rows.columns, F.inline("regions"))
            .where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))))


def _narrow(rows: DataFrame, regions: DataFrame, by: str, scale) -> DataFrame:
    counts = (_inside(rows, regions, by)
              .groupBy(by, F.col("low").alias("of"), _step(scale).alias("step"))
              .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    upto = F.sum("n").over(W.partitionBy(by, "of").orderBy("step").rowsBetween(
        W.unboundedPreceding, W.currentRow))
    wanted = regions.select(by, F.inline("regions")).select(
        by, F.col("low").alias("of"), F.inline("wants"))
    held = (counts.withColumn("upto", upto).join(wanted, [by, "of"])
            .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
            .groupBy(by, "n", "low", "high")
            .agg(F.collect_list(F.struct("mark", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
                 .alias("wants")))
    return held.groupBy(by).agg(F.collect_list(F.struct("n", "low", "high", "wants")).alias("regions"))


def first_regions(groups: DataFrame, by: str) -> DataFrame:
    """Starting ranges from (by, n, low, high, wants), one row per group.

    ``wants`` is an array of (mark, rank): which ranks, counted from 1, are
    wanted and the number each is reported under.
    """
    return groups.where(F.size("wants") > 0).select(
        by, F.array(F.struct("n", "low", "high", "wants")).alias("regions"))


def ranked_rows(rows: DataFrame, regions: DataFrame, by: str,
                scale: Callable[[Column], Column] = logarithmic, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(by, marks): for every group a map from mark to the (v, tie) of its rank.

    ``rows`` has (by, v, tie) and is ordered by v, then tie. A constant tie
    makes equal values count as one entry with a multiplicity.
    """
    regions = settle(regions)
    for _ in range(LEVELS):
        large = F.exists("regions", lambda r: (r["n"] > rank_rows) & (r["low"] < r["high"]))
        if not regions.where(large).take(1):
            break
        regions = settle(_narrow(rows, regions, by, scale))
    entries = _inside(rows, regions.select(by, F.transform("regions", lambda r: F.struct(
        r["low"].alias("low"), r["high"].alias("high"))).alias("regions")), by).groupBy(
        by, "low", "v", "tie").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(by, "low").orderBy("v", "tie").rowsBetween(
        W.unboundedPreceding, W.currentRow))
    wanted = regions.select(by, F.inline("regions")).select(by, "low", F.inline("wants"))
    return (entries.withColumn("upto", upto).join(wanted, [by, "low"])
            .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
            .groupBy(by).agg(F.map_from_entries(F.collect_list(
                F.struct("mark", F.struct("v", "tie")))).alias("marks")))
