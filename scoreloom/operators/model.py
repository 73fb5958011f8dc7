"""Text-pair classifiers as Spark ML pipelines, and untrained baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, Window as W

from scoreloom.functions.hashing import row_draw
from scoreloom.functions.probability import argmax, confidence, negative_log_likelihood
from scoreloom.functions.text import tokens
from scoreloom.operators import metrics
from scoreloom.operators.selection import best_candidate
from scoreloom.schema import REFERENCE, ROW_ID, STUDENT
from scoreloom.session import gathered, scratch_path

HASH_FEATURES = 1 << 16


def pair_features(df: DataFrame, student: str = STUDENT, reference: str = REFERENCE) -> DataFrame:
    """Marked tokens of both texts, share of reference words answered, lengths. Narrow.

    A NULL text counts as the empty one.
    """
    texts = {"_s": F.coalesce(F.col(student), F.lit("")), "_r": F.coalesce(F.col(reference), F.lit(""))}
    words = df.withColumns({c: tokens(F.lower(text)) for c, text in texts.items()})
    found, wanted = F.size(F.array_intersect("_s", "_r")), F.size(F.array_distinct("_r"))
    marked = F.concat(F.transform("_s", lambda t: F.concat(F.lit("s "), t)),
                      F.transform("_r", lambda t: F.concat(F.lit("r "), t)))
    return words.withColumns({
        "pair_tokens": marked,
        "overlap": F.coalesce(F.try_divide(found.cast("double"), wanted.cast("double")), F.lit(0.0)),
        "log_student": F.log1p(F.length(texts["_s"])), "log_reference": F.log1p(F.length(texts["_r"])),
    }).drop("_s", "_r")


def _feature_stages(size: int):
    """The tokens carry their side, so one hashed space and one IDF pass serve both texts."""
    return [
        HashingTF(inputCol="pair_tokens", outputCol="pair_tf", numFeatures=size),
        IDF(inputCol="pair_tf", outputCol="pair_tfidf"),
        VectorAssembler(inputCols=["pair_tfidf", "overlap", "log_student", "log_reference"],
                        outputCol="features")]


def _classifier(label: str, reg: float, max_iter: int, weight: str | None) -> LogisticRegression:
    lr = LogisticRegression(labelCol=label, featuresCol="features", family="multinomial",
                            regParam=reg, maxIter=max_iter)
    return lr.setWeightCol(weight) if weight else lr


def fit_pair_classifier(train: DataFrame, label: str = "label", reg: float = 0.01,
                        max_iter: int = 20, weight: str | None = None,
                        size: int = HASH_FEATURES, earlier: DataFrame | None = None) -> PipelineModel:
    """Fit on a graded table with a label column.

    ``weight`` names a row-weight column. ``earlier`` holds the rows of an
    earlier fit: the new model continues from it by fitting on both.
    """
    rows = pair_features(train)
    if earlier is not None:
        rows = rows.unionByName(pair_features(earlier), allowMissingColumns=False)
    return Pipeline(stages=[*_feature_stages(size), _classifier(label, reg, max_iter, weight)]).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add logits, p and confidence to every row. Narrow: no row moves."""
    scored = model.transform(pair_features(df)).withColumn("logits", vector_to_array("rawPrediction"))
    return scored.select(*df.columns, "logits", argmax(F.col("logits")).alias("p"),
                         confidence(F.col("logits")).alias("confidence"))


def fit_candidates(train: DataFrame, validation: DataFrame, regs: Sequence[float],
                   label: str = "label", max_iter: int = 20, weight: str | None = None,
                   size: int = HASH_FEATURES) -> tuple[DataFrame, dict[float, PipelineModel]]:
    """Fit one model per regularisation strength and score each on validation rows.

    Returns (candidate, reg, n, eval_loss, ...) rows and the models. Texts are
    turned into features once, for both tables; candidates work on the stored
    features. All candidates are judged in one pass.
    """
    features = Pipeline(stages=_feature_stages(size)).fit(pair_features(train))

    def prepared(rows: DataFrame, *more: str) -> DataFrame:
        path = scratch_path(rows.sparkSession, "features")
        ready = features.transform(pair_features(rows)).select("features", label, *more)
        ready.write.parquet(path)
        return rows.sparkSession.read.schema(ready.schema).parquet(path)

    fitting, judging = prepared(train, *([weight] if weight else [])), prepared(validation)
    models, parts = {}, []
    for i, reg in enumerate(regs):
        lr = _classifier(label, reg, max_iter, weight).fit(fitting)
        models[reg] = PipelineModel([*features.stages, lr])
        logits = vector_to_array("rawPrediction")
        parts.append(lr.transform(judging).select(
            F.lit(i).alias("candidate"), F.lit(float(reg)).alias("reg"), F.col(label).alias("y"),
            argmax(logits).alias("p"), logits.alias("logits")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return candidate_metrics(every, ("candidate", "reg")), models


def best_model(train: DataFrame, validation: DataFrame, regs: Sequence[float], metric: str = "eval_loss",
               greater_is_better: bool = False, **how) -> tuple[float, PipelineModel, DataFrame]:
    """The candidate with the best validation metric: (reg, model, metrics of all)."""
    candidates, models = fit_candidates(train, validation, regs, **how)
    rows = candidates.sparkSession.createDataFrame(candidates.toArrow(), candidates.schema)      # one row per candidate
    best = best_candidate(rows.withColumn("run", F.lit("fit")), metric, greater_is_better, order="candidate").first()
    reg = regs[best["best_candidate"]]
    return reg, models[reg], rows


def candidate_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., eval_loss, f1_weighted) from rows with y, p and logits, in one pass."""
    cells = gathered(scored.groupBy(*by, "y", "p").agg(
        F.count("*").alias("n"),
        F.sum(negative_log_likelihood(F.col("logits"), F.col("y"))).alias("loss_sum")))
    scores = metrics.metrics_summary(cells, by, {"loss_sum": F.sum})
    loss = F.try_divide(F.col("loss_sum"), F.col("n").cast("double"))
    return scores.select(*by, "n", loss.alias("eval_loss"), "accuracy", "f1_macro", "f1_weighted")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def baseline_predictions(df: DataFrame, classes: int, y: str = "y", row_id: str = ROW_ID,
                         seed: int = 42) -> DataFrame:
    """(baseline, y, p, n) cells of two untrained scorers.

    ``random`` draws a class from a hash of the row; ``majority`` always gives
    the most frequent class, the first one on ties. Both come from one pass: the
    majority cells are a relabelling of the random ones.
    """
    cells = metrics.confusion_cells(df.select(
        F.col(y).alias("y"), (row_draw(df, row_id, seed) % classes).alias("p")))
    every = W.partitionBy(F.lit(0))
    ranked = (cells.withColumn("_class", F.struct(
        F.sum("n").over(W.partitionBy("y")).alias("n"), (-F.col("y")).alias("y")))
        .withColumn("_top", -F.max("_class").over(every)["y"]))
    both = F.array(F.struct(F.lit("random").alias("baseline"), F.col("p")),
                   F.struct(F.lit("majority").alias("baseline"), F.col("_top").alias("p")))
    return metrics.sum_cells(ranked.select("y", "n", F.inline(both)), ("baseline",))
