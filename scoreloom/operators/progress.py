"""Comparison of model runs and of neighbouring versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from scoreloom.operators import metrics

RUN_KEYS = ("run_order", "run")


def run_metrics(cells: DataFrame) -> DataFrame:
    """(run_order, run, accuracy, f1_macro) of every run, missing metrics as 0."""
    scores = metrics.metrics_summary(cells, RUN_KEYS)
    return scores.select(*RUN_KEYS, *[F.coalesce(c, F.lit(0.0)).alias(c)
                                      for c in ("accuracy", "f1_macro")])


def _transition(window) -> Column:
    return F.concat(F.lag("run").over(window), F.lit("→"), F.col("run"))


def run_progress(scores: DataFrame) -> DataFrame:
    """Metrics in percent and their change since the version before.

    ``scores`` has one row per run; the ordering window sees only those.
    """
    versions = W.orderBy("run_order")
    shown = scores.select(*RUN_KEYS, (F.col("accuracy") * 100).alias("accuracy_pct"),
                          (F.col("f1_macro") * 100).alias("f1_macro_pct"))
    return shown.withColumns({
        "accuracy_change": F.col("accuracy_pct") - F.lag("accuracy_pct").over(versions),
        "f1_macro_change": F.col("f1_macro_pct") - F.lag("f1_macro_pct").over(versions),
        "transition": _transition(versions),
    })


def class_progress(cells: DataFrame) -> DataFrame:
    """Accuracy per true class in percent and its change since the version before."""
    shown = metrics.per_class_accuracy(cells, RUN_KEYS).select(
        *RUN_KEYS, "y", (F.col("accuracy") * 100).alias("accuracy_pct"))
    versions = W.partitionBy("y").orderBy("run_order")
    return shown.withColumns({
        "change": F.col("accuracy_pct") - F.lag("accuracy_pct").over(versions),
        "transition": _transition(versions),
    })


def significant_changes(changes: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Changes of more than ``threshold`` percent points in either direction."""
    return changes.where(F.abs("change") > threshold)


def class_table(cells: DataFrame, classes: int) -> DataFrame:
    """Display form: one row per run, one accuracy column per class."""
    wide = (metrics.per_class_accuracy(cells, RUN_KEYS).groupBy(*RUN_KEYS)
            .pivot("y", list(range(classes))).agg(F.first("accuracy") * 100))
    return wide.withColumnsRenamed({str(k): f"class_{k}" for k in range(classes)})


def total_progress(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """First value, last value and their difference, in version order."""
    return values.groupBy(*by).agg(
        F.min_by(value, "run_order").alias("first_pct"),
        F.max_by(value, "run_order").alias("last_pct"),
    ).withColumn("total_change", F.col("last_pct") - F.col("first_pct"))


def improvement_over(scores: DataFrame, baseline: str) -> DataFrame:
    """Every other run's gain in accuracy and macro F1 over a baseline run.

    The baseline's values are spread over the run rows by a window; there is
    one row per run.
    """
    every = W.partitionBy(F.lit(0))

    def base(c: str):
        return F.max(F.when(F.col("run") == baseline, F.col(c))).over(every)

    return (scores.select(
        *RUN_KEYS, "accuracy", "f1_macro",
        base("accuracy").alias("baseline_accuracy"), base("f1_macro").alias("baseline_f1_macro"))
        .withColumns({
            "improvement_accuracy": F.col("accuracy") - F.col("baseline_accuracy"),
            "improvement_f1_macro": F.col("f1_macro") - F.col("baseline_f1_macro")})
        .where(F.col("run") != baseline))
