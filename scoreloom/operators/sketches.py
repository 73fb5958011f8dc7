"""Quantile summaries that can be stored per part of the input and merged later.

Where exact quantiles of a table that only grows would read all of it again, one
small sketch per part and group is kept; new parts add rows, and any choice of
parts merges into quantiles without the data. A sketch of ``k`` = ``K`` holds the
rank of a value within ``RANK_ERROR`` of the rows (``exact_quantiles`` has no error).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

K = 1600
# Published error of such a sketch: 0.3 % of the rows at 99 % confidence; about three times that is promised.
RANK_ERROR = 0.01


def sketch_parts(df: DataFrame, value: str, by: Sequence[str], part: str, k: int = K) -> DataFrame:
    """(by..., part, n, sketch): one row per group and part, from one map-side combined aggregation.

    NULL and NaN do not count; a group without other values has no row.
    """
    v = F.col(value).cast("double")
    return (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, F.col(part).alias("part"))
            .agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch")))


def merged(parts: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """(by..., n, sketch) of all parts given."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by..., n, quantiles): a value of the data for every probability."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in probs]
    return sketches.select(*by, "n", F.array(*found).alias("quantiles"))


def sketched_rank(sketches: DataFrame, by: Sequence[str], value: float) -> DataFrame:
    """(by..., n, rank): share of the rows up to a value."""
    return sketches.select(*by, "n", F.kll_sketch_get_rank_double("sketch", F.lit(float(value))).alias("rank"))
