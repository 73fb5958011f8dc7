"""A two-class prediction judged against several reductions of the grades.

The prediction does not depend on the reduction, and the reduction depends
only on the grade. So the rows are counted once per (grade, prediction), and
the reductions are applied to those few counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scoreloom.operators import metrics
from scoreloom.operators.labels import REMAPPINGS, Remapping, remap
from scoreloom.schema import GRADE
from scoreloom.session import gathered

KEYS = ("strategy_order", "strategy")


def grade_cells(df: DataFrame, p: str = "p", grade: str = GRADE) -> DataFrame:
    """(grade, p, n): the only pass over the rows."""
    return gathered(df.groupBy(F.col(grade).alias("grade"), F.col(p).cast("int").alias("p")).agg(
        F.count("*").alias("n")))


def strategy_cells(cells: DataFrame, remappings: Sequence[Remapping] = REMAPPINGS) -> DataFrame:
    """(strategy_order, strategy, description, grade, y, p, n)."""
    return remap(cells, remappings, "grade").withColumnRenamed("binary_label", "y")


def strategy_metrics(cells: DataFrame, remappings: Sequence[Remapping] = REMAPPINGS,
                     grades: Sequence[str] = ()) -> DataFrame:
    """Per strategy: accuracy, both F1s, the matrix and both label histograms.

    ``grades`` asks for the number of rows per original grade as well, and of
    those with another grade or none.
    """
    none = F.lit(0).cast("bigint")
    other = ~F.coalesce(F.col("grade").isin(*grades), F.lit(False))
    counts = metrics.cell_counts(2) | {
        f"grade_{g}": F.when(F.col("grade") == g, F.col("n")).otherwise(none) for g in grades}
    if grades:
        counts["grade_other"] = F.when(other, F.col("n")).otherwise(none)
    fanned = strategy_cells(cells, remappings).withColumns(counts)
    scores = metrics.metrics_summary(fanned, (*KEYS, "description"), {c: F.sum for c in counts})

    def total(*names):
        return sum((F.col(c) for c in names[1:]), F.col(names[0]))

    return scores.withColumns({
        "true_0": total("n_00", "n_01"), "true_1": total("n_10", "n_11"),
        "pred_0": total("n_00", "n_10"), "pred_1": total("n_01", "n_11")})


def grade_breakdown(cells: DataFrame, remappings: Sequence[Remapping] = REMAPPINGS) -> DataFrame:
    """Per strategy and original grade: accuracy and how the grade was predicted."""
    def count(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0).cast("bigint")))

    def percent(c):
        return F.try_divide(F.col(c).cast("double"), F.col("n").cast("double")) * 100

    counted = strategy_cells(cells, remappings).groupBy(*KEYS, "grade").agg(
        F.sum("n").alias("total"), count(F.col("y") == F.col("p")).alias("hits"),
        count(F.col("p") == 0).alias("pred_as_0"), count(F.col("p") == 1).alias("pred_as_1"))
    return (counted.withColumnRenamed("total", "n")
            .withColumn("accuracy", F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double")))
            .withColumn("pct_as_0", percent("pred_as_0")).withColumn("pct_as_1", percent("pred_as_1"))
            .drop("hits"))


def best_strategy(scores: DataFrame) -> DataFrame:
    """The strategy with the highest accuracy (the first on ties) and its verdict."""
    best = scores.orderBy(F.desc("accuracy"), F.asc("strategy_order")).limit(1)
    # Accuracy bands of the verdict.
    verdict = (F.when(F.col("accuracy") > 0.7, "good")
               .when(F.col("accuracy") > 0.5, "medium").otherwise("low"))
    return best.select("strategy", "accuracy", verdict.alias("verdict"))
