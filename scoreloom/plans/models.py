"""Classifier fits on graded documents, and the nested reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.bins import LENGTH_BINS, RATIO_BINS
from scoreloom.operators import epochs, labels, metrics, model, progress, selection, splits, strategies
from scoreloom.operators.labels import FOUR_GRADE_INDEX
from scoreloom.operators.weights import class_weights
from scoreloom.plans.adapters import (
    BULK_SQL, GRADED_SCORED, GRADED_SQL, binary_prediction, bulk, graded, graded_scored, runs)
from scoreloom.plans.comparison import RUN_SCORES
from scoreloom.plans.evaluation import JUDGED, STRATEGY_SCORES, scores_sql
from scoreloom.plans.length_study import ANOVA_SQL, bin_rows_sql, bin_sql
from scoreloom.plans.registry import query, steps
from scoreloom.plans.tables import split_sql as splits_sql
from scoreloom.schema import FOUR_GRADES, GRADE, QUESTION, REFERENCE, STUDENT
from scoreloom.session import scratch_path
from scoreloom.sinks import report


def _parts(spark, rows, keep, names):
    """Split once, store the enriched rows by split, and read the parts back."""
    path = scratch_path(spark, "split")
    report.write_table(splits.stratified_split(rows, GRADE, keep, names), path)
    stored = spark.read.schema(rows.schema.add("split", "string")).parquet(path)
    return [stored.where(F.col("split") == name) for name in names]


def _fit_check(source, keep, names, part):
    """What SQL knows of a fit: the rows of each class in the judged part, and that
    all of them are scored with a known class."""
    return steps(*source, *splits_sql("labelled", names, keep, f"""
  SELECT label, count(*) AS support, count(*) AS scored, 0::BIGINT AS outside
  FROM split_rows JOIN (SELECT row_id, label FROM labelled) USING (row_id) WHERE split = '{part}' GROUP BY label"""))


def _judged(scored, classes):
    """One row per true class: support, rows scored, predictions outside the classes."""
    cells = metrics.confusion_cells(scored)
    inside = F.col("p").between(0, classes - 1)
    return cells.groupBy(F.col("y").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).alias("scored"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("bigint").alias("outside"))


_BINARY = (GRADED_SQL, ("labelled", """
  SELECT row_id, grade, CASE grade WHEN '2' THEN 0 ELSE 1 END::INT AS label FROM graded WHERE grade IN ('2', '5')"""))
_FOUR = (GRADED_SQL, ("labelled", "SELECT row_id, grade, (dense_rank() OVER (ORDER BY grade) - 1)::INT AS label FROM graded"))
_CONTINUED = {"keep": (0.4, 0.75), "names": ("earlier", "train", "test")}
_REGS = (0.001, 0.01, 0.1)


@query("fit_binary", _fit_check(_BINARY, part="test", **splits.THREE_WAY))
def _(spark, sf_dir):
    rows = labels.encode_labels(graded(spark, sf_dir).where(F.col(GRADE).isin("2", "5")))
    train, _, test = _parts(spark, rows, **splits.THREE_WAY)
    path = scratch_path(spark, "binary-model")
    model.save_model(model.fit_pair_classifier(train), path)
    return _judged(model.predict(model.load_model(path), test).withColumnRenamed("label", "y"), 2)


@query("fit_multiclass_weighted", _fit_check(_FOUR, part="test", **_CONTINUED))
def _(spark, sf_dir):
    rows = labels.encode_labels(graded(spark, sf_dir))
    earlier, train, test = _parts(spark, rows, **_CONTINUED)
    # One weight per class, joined; a class is a row of a table of any size.
    weights = class_weights(train).select("label", "weight")

    def weighed(part):
        return part.join(weights, "label", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))

    fitted = model.fit_pair_classifier(weighed(train), weight="weight", earlier=weighed(earlier))
    return _judged(model.predict(fitted, test).withColumnRenamed("label", "y"), 4)


@query("fit_candidates", _fit_check(_FOUR, part="test", **splits.THREE_WAY))
def _(spark, sf_dir):
    """Fit candidates, choose by validation loss, and judge the chosen model on the test part."""
    rows = labels.encode_labels(graded(spark, sf_dir))
    train, validation, test = _parts(spark, rows, **splits.THREE_WAY)
    _, chosen, _ = model.best_model(train, validation, _REGS)
    return _judged(model.predict(chosen, test).withColumnRenamed("label", "y"), 4)


_LEARNED = ("loss_falls", "best_is_least", "stop_agrees", "best_is_returned", "beats_majority")


@query("fit_epochs", steps(*_FOUR, *splits_sql("labelled", **splits.THREE_WAY, output=f"""
  SELECT count(*) AS judged, {", ".join(f"true AS {flag}" for flag in _LEARNED)}
  FROM split_rows JOIN (SELECT row_id, label FROM labelled) USING (row_id) WHERE split = 'test'""")))
def _(spark, sf_dir):
    """Epochs with early stop. What must hold of a fit: the loss falls, the best
    epoch has the least, the stop is the one the history gives, the returned model
    has the loss of the best epoch, and it beats the constant answer on the test part."""
    rows = labels.encode_labels(graded(spark, sf_dir))
    train, validation, test = _parts(spark, rows, **splits.THREE_WAY)
    fit = epochs.fit_epochs(train, validation, classes=4, epochs=5)
    history = fit.history.withColumn("run", F.lit("fit"))
    best = selection.best_candidate(history, "eval_loss", False).first()
    stop = selection.early_stop(history, "eval_loss", False, patience=2).first()["stop_epoch"]
    first = history.where("epoch = 1").first()["eval_loss"]

    def cells(part):
        return model.predict(fit.model, part).withColumnRenamed("label", "y")

    again = model.candidate_metrics(cells(validation).withColumn("run", F.lit("fit")), ("run",)).first()["eval_loss"]
    judged = metrics.confusion_cells(cells(test))
    of_class = judged.groupBy("y").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    flags = dict(zip(_LEARNED, (best["best_eval_loss"] < first or fit.best_epoch == 1, best["best_epoch"] == fit.best_epoch,
                                stop == fit.stop_epoch, abs(again - best["best_eval_loss"]) < 1e-9)))
    return of_class.agg(F.sum("n").alias("judged"), *[F.lit(bool(v)).alias(k) for k, v in flags.items()],
                        (F.sum("hits") >= F.max("n")).alias("beats_majority"))


def _stored(spark, document, name):
    """Write a report, read it back with the same schema."""
    path = scratch_path(spark, name)
    report.write_report(document, path)
    return spark.read.schema(document.schema).json(path)


def _bin_section(section: str, value: str, bins) -> str:
    """Accuracy of every bin of a report section, empty bins included."""
    _, rows = bin_rows_sql(bins)
    return f"""SELECT '{section}' AS section, b.bin_label AS key, round(avg((s.y = s.p)::INT), 6) AS value
    FROM ({rows}) b LEFT JOIN src s ON {bin_sql('s.' + value, bins)} = b.bin_id GROUP BY b.bin_label"""


_STATISTICS = {
    "count": "count(*)::DOUBLE", "mean": "avg(answer_length)", "std": "stddev_samp(answer_length)", "min": "min(answer_length)::DOUBLE",
    "25%": "quantile_cont(answer_length, 0.25)", "50%": "quantile_cont(answer_length, 0.5)",
    "75%": "quantile_cont(answer_length, 0.75)", "max": "max(answer_length)::DOUBLE"}
_SCALARS = ("correlation_length_grade", "correlation_relation_grade", "anova_f", "anova_p")


@query("report_json", steps(*GRADED_SCORED, ("src", "SELECT * FROM scored"), *ANOVA_SQL, " UNION ALL ".join([
    _bin_section("accuracy_by_length", "answer_length", LENGTH_BINS), _bin_section("accuracy_by_relation", "length_ratio", RATIO_BINS),
    "SELECT 'scalars', 'correlation_length_grade', round(corr(answer_length, y), 6) FROM src",
    "SELECT 'scalars', 'correlation_relation_grade', round(corr(length_ratio, y), 6) FROM src",
    "SELECT 'scalars', 'anova_f', round(f, 6) FROM tail", "SELECT 'scalars', 'anova_p', round(p, 6) FROM tail",
    *[f"SELECT '{name}', grade, round({sql}, 6) FROM src GROUP BY grade" for name, sql in _STATISTICS.items()]])))
def _(spark, sf_dir):
    stored = _stored(spark, report.length_report(graded_scored(spark, sf_dir), FOUR_GRADES), "length-report")
    scalars = F.create_map(*[x for c in _SCALARS for x in (F.lit(c), F.col(c))])
    sections = F.array(
        F.struct(F.lit("accuracy_by_length").alias("section"), F.col("accuracy_by_length").alias("m")),
        F.struct(F.lit("accuracy_by_relation").alias("section"), F.col("accuracy_by_relation").alias("m")),
        F.struct(F.lit("scalars").alias("section"), scalars.alias("m")),
        *[F.struct(F.lit(s).alias("section"), F.col("grade_statistics")[s].alias("m")) for s in _STATISTICS])
    return stored.select(F.inline(sections)).select("section", F.explode("m"))


def _spelled(numbers):
    return F.array_join(F.transform(numbers, lambda v: v.cast("string")), " ")


@query("report_strategies", steps(BULK_SQL, JUDGED, STRATEGY_SCORES, ("s", """
  SELECT strategy_order, strategy, sum(support)::BIGINT AS n, sum(hits)::DOUBLE / sum(support) AS accuracy,
    avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM class_scores GROUP BY ALL"""), ("m", """
  SELECT strategy, any_value(description) AS description, concat_ws(' ', count(*) FILTER (y = 0 AND p = 0), count(*) FILTER (y = 0 AND p = 1),
      count(*) FILTER (y = 1 AND p = 0), count(*) FILTER (y = 1 AND p = 1)) AS confusion_matrix,
    concat_ws(' ', count(*) FILTER (y = 0), count(*) FILTER (y = 1)) AS true_distribution,
    concat_ws(' ', count(*) FILTER (p = 0), count(*) FILTER (p = 1)) AS pred_distribution FROM judged GROUP BY strategy"""), """
  SELECT strategy, description, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted,
    confusion_matrix, true_distribution, pred_distribution, n AS total_samples,
    strategy = (SELECT strategy FROM s ORDER BY accuracy DESC, strategy_order LIMIT 1) AS is_best,
    round((SELECT max(accuracy) FROM s), 6) AS best_accuracy,
    (SELECT string_agg(grade || ':' || n, ' ' ORDER BY grade) FROM (SELECT grade, count(*) AS n FROM bulk GROUP BY grade)) AS original_distribution
  FROM s JOIN m USING (strategy)"""))
def _(spark, sf_dir):
    cells = strategies.grade_cells(bulk(spark, sf_dir).withColumn("bp", binary_prediction()), "bp")
    stored = _stored(spark, report.strategy_report(cells), "strategy-report")
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("original_distribution")), lambda e: F.concat_ws(
        ":", e["key"], e["value"].cast("string"))), " ")
    return stored.select(F.explode("strategies").alias("strategy", "s"), "summary", counts.alias("original_distribution")).select(
        "strategy", "s.description", "s.accuracy", "s.f1_macro", "s.f1_weighted",
        _spelled(F.flatten("s.confusion_matrix")).alias("confusion_matrix"), _spelled("s.true_distribution").alias("true_distribution"),
        _spelled("s.pred_distribution").alias("pred_distribution"), "summary.total_samples",
        (F.col("strategy") == F.col("summary.best_strategy")).alias("is_best"), "summary.best_accuracy", "original_distribution")


@query("report_evaluation", steps(BULK_SQL, scores_sql("bulk"), """
  SELECT n AS total_samples, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro,
    round(c_mean, 6) AS confidence_mean, c_min AS confidence_min, c_max AS confidence_max,
    (SELECT string_agg(c, ' ' ORDER BY y, p) FROM (SELECT a.k AS y, b.k AS p, count(x.row_id)::VARCHAR AS c
      FROM range(0, 4) a(k), range(0, 4) b(k) LEFT JOIN bulk x ON x.y = a.k AND x.p = b.k GROUP BY ALL)) AS confusion_matrix,
    '2 3 4 5' AS class_names
  FROM (SELECT sum(support)::BIGINT AS n, sum(hits)::DOUBLE / sum(support) AS accuracy, avg(f1) AS f1_macro FROM class_scores),
    (SELECT avg(confidence) AS c_mean, min(confidence) AS c_min, max(confidence) AS c_max FROM bulk)"""))
def _(spark, sf_dir):
    stored = _stored(spark, report.evaluation_report(bulk(spark, sf_dir), FOUR_GRADE_INDEX), "evaluation")
    return stored.select(
        "summary.total_samples", "summary.accuracy", "summary.f1_macro",
        F.col("summary.confidence_stats.mean").alias("confidence_mean"),
        F.col("summary.confidence_stats.min").alias("confidence_min"),
        F.col("summary.confidence_stats.max").alias("confidence_max"),
        _spelled(F.flatten("confusion_matrix")).alias("confusion_matrix"), F.array_join("class_names", " ").alias("class_names"))


@query("split_stored", steps(GRADED_SQL, *splits_sql(
    "graded", splits.THREE_WAY["names"], splits.THREE_WAY["keep"], """
  SELECT row_id, split, grade, md5(question) AS question, md5(student_answer) AS student_answer, md5(reference_answer) AS reference_answer
  FROM split_rows JOIN graded USING (row_id, grade)""")))
def _(spark, sf_dir):
    """The enriched table, written by split and read back."""
    parts = _parts(spark, graded(spark, sf_dir), **splits.THREE_WAY)
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("row_id", "split", "grade", *[F.md5(c).alias(c) for c in (QUESTION, STUDENT, REFERENCE)])


@query("report_baseline", steps(*RUN_SCORES, """
  SELECT round(b.accuracy, 6) AS baseline_accuracy, round(b.f1_macro, 6) AS baseline_f1_macro,
    round(t.accuracy, 6) AS trained_accuracy, round(t.f1_macro, 6) AS trained_f1_macro,
    round(t.accuracy - b.accuracy, 6) AS improvement_accuracy, round(t.f1_macro - b.f1_macro, 6) AS improvement_f1_macro
  FROM run_scores b, run_scores t WHERE b.run = 'baseline' AND t.run = 'v4'"""))
def _(spark, sf_dir):
    document = report.baseline_report(progress.run_metrics(runs(spark, sf_dir)), "baseline", "v4")
    return _stored(spark, document, "baseline-report").drop("run_id")
