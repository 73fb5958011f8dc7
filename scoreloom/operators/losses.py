"""Cross-entropy over a table of logits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from scoreloom.functions.probability import negative_log_likelihood
from scoreloom.operators.weights import MANUAL_BOOST, weights_of_counts
from scoreloom.session import gathered


def class_losses(df: DataFrame, logits: str = "logits", label: str = "y",
                 by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, n, loss_sum): the only pass over the rows.

    Summing per class first means that class weights meet K rows and never
    the table itself.
    """
    return gathered(df.groupBy(*by, F.col(label).cast("int").alias("label")).agg(
        F.count("*").alias("n"),
        F.sum(negative_log_likelihood(F.col(logits), F.col(label))).alias("loss_sum")))


def log_loss(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy."""
    return losses.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("loss_sum"), F.sum("n").cast("double")).alias("log_loss"))


def weighted_log_loss(losses: DataFrame, weights: DataFrame | None = None,
                      by: Sequence[str] = ()) -> DataFrame:
    """Sum of weighted losses over the sum of weights.

    ``weights`` has (label, weight); a class without a weight stops the job.
    ``losses`` may carry a ``weight`` column itself (see ``weigh``). No weights
    at all give ``log_loss``.
    """
    if weights is None and "weight" not in losses.columns:
        return log_loss(losses, by)
    if weights is not None:
        losses = losses.drop("weight").join(weights.select("label", "weight"), "label", "left")
    complaint = F.concat(F.lit("class without a weight: "), F.coalesce(F.col("label").cast("string"), F.lit("NULL")))
    weighed = losses.withColumn("weight", F.coalesce(F.col("weight"), F.raise_error(complaint).cast("double")))
    return weighed.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("loss_sum") * F.col("weight")),
                     F.sum(F.col("n") * F.col("weight"))).alias("log_loss"))


def weigh(losses: DataFrame, boost: Mapping[int, float] = MANUAL_BOOST) -> DataFrame:
    """Class losses with the balanced, boosted weight of each class.

    The weights follow from the row counts that the losses already hold, so
    the table is read once for both.
    """
    return weights_of_counts(losses, boost, "loss_sum").select("label", "n", "loss_sum", "weight")
