"""Class weights against imbalance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from scoreloom.operators.labels import literal_map
from scoreloom.session import gathered

# Extra weight of the labels 2 and 3.
MANUAL_BOOST = {2: 1.4, 3: 1.5}


def class_weights(df: DataFrame, label: str = "label",
                  boost: Mapping[int, float] = MANUAL_BOOST) -> DataFrame:
    """(label, n, balanced, weight) with balanced = rows / (classes * rows of class).

    One pass; the totals are taken over the K class counts, which are gathered
    into one row and opened again.
    """
    counts = gathered(df.where(F.col(label).isNotNull()).groupBy(
        F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n")))
    return weights_of_counts(counts, boost)


def weights_of_counts(counts: DataFrame, boost: Mapping[int, float] = MANUAL_BOOST, *carry: str) -> DataFrame:
    """``class_weights`` from (label, n) rows, one per class; ``carry`` columns stay."""
    totals = counts.agg(
        F.sum("n").alias("total"), F.count("*").alias("classes"),
        F.collect_list(F.struct("label", "n", *carry)).alias("per_class"))
    balanced = F.col("total").cast("double") / (F.col("classes") * F.col("n"))
    return (totals.select("total", "classes", F.inline("per_class"))
            .withColumn("balanced", balanced)
            .withColumn("weight", F.col("balanced") * literal_map(boost, F.col("label"), 1.0))
            .select("label", "n", *carry, "balanced", "weight"))
