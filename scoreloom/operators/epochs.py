"""Training in epochs: evaluate after each, stop early, keep the best, go on later.

An epoch is a bounded number of optimiser steps of a multilayer perceptron over
all training rows. Its weights are the starting point of the next epoch, and
those of a stored model the starting point of a later fit on other rows. Only
weights, of a size set by the layers, pass the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from scoreloom.functions.probability import argmax
from scoreloom.operators.model import _feature_stages, candidate_metrics, pair_features
from scoreloom.session import written

FEATURES = 1 << 9           # hashed tokens; every one has a weight per hidden unit
HIDDEN = (16,)


@dataclass(frozen=True)
class EpochFit:
    """The best model, the metrics of all epochs (epoch, eval_loss, f1_weighted, ...),
    the best epoch, and the epoch that ended the fit early, if one did."""

    model: PipelineModel
    history: DataFrame
    best_epoch: int
    stop_epoch: int | None


def fit_epochs(train: DataFrame, validation: DataFrame, classes: int, label: str = "label",
               metric: str = "eval_loss", greater_is_better: bool = False, epochs: int = 10,
               steps: int = 5, patience: int = 2, start: PipelineModel | None = None,
               hidden: Sequence[int] = HIDDEN, size: int = FEATURES, seed: int = 42) -> EpochFit:
    """Fit up to ``epochs`` epochs of ``steps`` optimiser steps each.

    Training ends once ``patience`` epochs in a row have not improved ``metric``
    on the validation rows; the first of equal epochs is the best. ``start`` is
    an earlier model: its features are kept and its weights are where the fit
    goes on. Labels are 0 .. classes - 1, rows without a label are left out.
    """
    if start is None:
        features = Pipeline(stages=_feature_stages(size)).fit(pair_features(train))
        weights = None
    else:
        features, weights = PipelineModel(start.stages[:-1]), start.stages[-1].weights

    def prepared(rows: DataFrame, name: str) -> DataFrame:
        ready = features.transform(pair_features(rows.where(F.col(label).isNotNull())))
        return written(ready.select("features", F.col(label).cast("double").alias("label")), name)

    fitting, judging = prepared(train, "epoch-train"), prepared(validation, "epoch-validation")
    width = fitting.schema["features"].metadata.get("ml_attr", {}).get("num_attrs") or fitting.first()["features"].size
    classifier = MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=steps, seed=seed)
    history, best, stop = [], None, None
    for epoch in range(1, epochs + 1):
        fitted = (classifier if weights is None else classifier.setInitialWeights(weights)).fit(fitting)
        weights = fitted.weights
        logits = vector_to_array("rawPrediction")
        scored = fitted.transform(judging).select(
            F.lit(epoch).alias("epoch"), F.col("label").cast("int").alias("y"), argmax(logits).alias("p"), logits.alias("logits"))
        row = candidate_metrics(scored, ("epoch",)).first()
        history.append(row)
        value = row[metric] if greater_is_better else -row[metric]
        if best is None or value > best[0]:
            best = value, epoch, fitted
        elif epoch - best[1] >= patience:
            stop = epoch
            break
    table = train.sparkSession.createDataFrame(history)
    return EpochFit(PipelineModel([*features.stages, best[2]]), table, best[1], stop)
