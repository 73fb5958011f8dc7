"""Choosing a checkpoint or candidate from a table of evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window as W


def best_candidate(candidates: DataFrame, metric: str, greater_is_better: bool,
                   by: Sequence[str] = ("run",), order: str = "epoch") -> DataFrame:
    """Candidate with the best metric per run, the earliest one on ties."""
    used = candidates.where(F.col(metric).isNotNull())
    sign = -1 if greater_is_better else 1
    pick = F.struct((F.col(metric) * sign).alias("k"), F.col(order).alias("o"))
    return used.groupBy(*by).agg(
        F.min_by(order, pick).alias(f"best_{order}"),
        (F.max(metric) if greater_is_better else F.min(metric)).alias(f"best_{metric}"))


def early_stop(candidates: DataFrame, metric: str, greater_is_better: bool, patience: int,
               by: Sequence[str] = ("run",), order: str = "epoch") -> DataFrame:
    """First epoch with ``patience`` evaluations in a row without improvement.

    Runs that keep improving have a NULL stop epoch. One row per epoch and run
    enters the window, so its groups stay short.
    """
    sofar = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sign = -1 if greater_is_better else 1
    key = F.struct((F.col(metric) * sign).alias("k"), F.col(order).alias("o"))
    tracked = candidates.withColumn("_best", F.min_by(order, key).over(sofar))
    waited = F.col(order) - F.col("_best") >= patience
    return tracked.groupBy(*by).agg(
        F.min(F.when(waited, F.col(order))).alias("stop_epoch"),
        F.max(order).alias("last_epoch"))
