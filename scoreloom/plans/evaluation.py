"""Evaluation queries on the large table: one set of cells, many metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import losses, metrics, model, selection, strategies
from scoreloom.operators.labels import REMAPPINGS, remap, value_counts
from scoreloom.operators.weights import class_weights
from scoreloom.functions.probability import argmax, confidence, softmax
from scoreloom.plans.adapters import (
    BINARY_SQL, BULK_SQL, CLASSES, EPOCH_ROWS_SQL, GRADED_SQL, LOGITS_SQL, binary_prediction, bulk,
    epoch_rows, grades, logit_rows, mix_sql)
from scoreloom.plans.registry import query, steps


def scores_sql(source: str, by: str = "", y: str = "y", p: str = "p"):
    """Per-class scores, written from the rows and not from cells."""
    lead = f"{by}, " if by else ""
    match = " AND ".join(f"t.{k} = q.{k}" for k in by.split(", ")) + " AND " if by else ""
    keys = "".join(f"coalesce(t.{k}, q.{k}) AS {k}, " for k in by.split(", ")) if by else ""
    return ("class_scores", f"""
  SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS precision,
    coalesce(hits::DOUBLE / nullif(support, 0), 0) AS recall,
    coalesce(2.0 * hits / nullif(support + predicted, 0), 0)::DOUBLE AS f1
  FROM (SELECT {keys}coalesce(t.label, q.label) AS label, coalesce(support, 0) AS support,
      coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
    FROM (SELECT {lead}{y} AS label, count(*) AS support, count(*) FILTER ({y} = {p}) AS hits
          FROM {source} GROUP BY ALL) t
    FULL JOIN (SELECT {lead}{p} AS label, count(*) AS predicted FROM {source} GROUP BY ALL) q
      ON {match}t.label = q.label)""")


_SUMMARY = """sum(support)::BIGINT AS n, round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy,
    round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted"""


def _cells(spark, sf_dir):
    return metrics.confusion_cells(bulk(spark, sf_dir))


@query("value_counts", steps(BULK_SQL, "SELECT grade, count(*) AS n FROM bulk GROUP BY grade"))
def _(spark, sf_dir):
    return value_counts(bulk(spark, sf_dir), "grade")


@query("bincount", steps(BULK_SQL, """
  SELECT k::INT AS label, count(b.y) AS n FROM range(0, (SELECT 2 * max(y) + 1 FROM bulk)) r(k)
  LEFT JOIN bulk b ON 2 * b.y = k GROUP BY k"""))
def _(spark, sf_dir):
    # Even labels only, so that the histogram has gaps to fill.
    return metrics.bincount(bulk(spark, sf_dir).withColumn("even", F.col("y") * 2), "even")


@query("collapse_check", steps(BULK_SQL, """
  SELECT count(*) AS bins, min(n) AS smallest, max(n) AS largest,
    count(*) = 1 OR min(n)::DOUBLE / max(n) < 0.1 AS collapsed
  FROM (SELECT k, count(p) AS n FROM range(0, (SELECT max(p) + 1 FROM bulk)) r(k) LEFT JOIN bulk ON p = k GROUP BY k)"""))
def _(spark, sf_dir):
    return metrics.collapse_check(bulk(spark, sf_dir), "p")


@query("confusion_matrix", steps(BULK_SQL, """
  SELECT a.k::INT AS y, b.k::INT AS p, count(c.row_id) AS n FROM range(0, 4) a(k), range(0, 4) b(k)
  LEFT JOIN bulk c ON c.y = a.k AND c.p = b.k GROUP BY ALL"""))
def _(spark, sf_dir):
    return metrics.label_grid(_cells(spark, sf_dir), 4)


@query("confusion_matrix_wide", steps(BULK_SQL, """
  SELECT y, """ + ", ".join(f"count(*) FILTER (p = {k}) AS pred_{k}" for k in range(4)) + """
  FROM bulk GROUP BY y"""))
def _(spark, sf_dir):
    return metrics.matrix_rows(_cells(spark, sf_dir), 4)


@query("metrics_summary", steps(BULK_SQL, scores_sql("bulk"), f"SELECT {_SUMMARY} FROM class_scores"))
def _(spark, sf_dir):
    return metrics.metrics_summary(_cells(spark, sf_dir))


@query("classification_report", steps(BULK_SQL, scores_sql("bulk"), """
  SELECT 0 AS line_order, label::VARCHAR AS line, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM class_scores
  UNION ALL SELECT 1, 'accuracy', NULL, NULL, round(sum(hits)::DOUBLE / sum(support), 6), sum(support)::BIGINT
  FROM class_scores
  UNION ALL SELECT 2, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
    sum(support)::BIGINT FROM class_scores
  UNION ALL SELECT 3, 'weighted avg', round(sum(precision * support) / sum(support), 6),
    round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
    sum(support)::BIGINT FROM class_scores"""))
def _(spark, sf_dir):
    return metrics.classification_report(_cells(spark, sf_dir))


@query("per_class_accuracy", steps(BULK_SQL, """
  SELECT y, count(*) AS n, round(avg((y = p)::INT), 6) AS accuracy FROM bulk GROUP BY y"""))
def _(spark, sf_dir):
    return metrics.per_class_accuracy(_cells(spark, sf_dir))


@query("confidence_stats", steps(BULK_SQL, """
  SELECT count(confidence) AS n, round(avg(confidence), 6) AS confidence_mean,
    round(min(confidence), 6) AS confidence_min, round(max(confidence), 6) AS confidence_max FROM bulk"""))
def _(spark, sf_dir):
    return metrics.confidence_stats(bulk(spark, sf_dir))


_STRATEGY_ROWS = ", ".join(
    f"({i}, '{m.name}', '{m.description}', {list(m.zero_grades)})" for i, m in enumerate(REMAPPINGS))
JUDGED = ("judged", f"""
  SELECT s.strategy_order, s.strategy, s.description, b.grade,
    CASE WHEN list_contains(s.zeros, b.grade) THEN 0 ELSE 1 END AS y, {BINARY_SQL} AS p
  FROM bulk b, (VALUES {_STRATEGY_ROWS}) s(strategy_order, strategy, description, zeros)""")
STRATEGY_SCORES = scores_sql("judged", "strategy_order, strategy")


def _grade_cells(spark, sf_dir):
    return strategies.grade_cells(bulk(spark, sf_dir).withColumn("bp", binary_prediction()), "bp")


@query("strategy_remap", steps(GRADED_SQL, f"""
  SELECT g.row_id, g.grade, s.strategy_order, s.strategy, s.description,
    CASE WHEN list_contains(s.zeros, g.grade) THEN 0 ELSE 1 END AS binary_label
  FROM graded g, (VALUES {_STRATEGY_ROWS}) s(strategy_order, strategy, description, zeros)"""))
def _(spark, sf_dir):
    return remap(grades(spark, sf_dir))


@query("strategy_metrics", steps(BULK_SQL, JUDGED, STRATEGY_SCORES, f"""
  SELECT * FROM (SELECT strategy_order, strategy, {_SUMMARY} FROM class_scores GROUP BY ALL)
  JOIN (SELECT strategy_order, strategy, description,
    """ + ", ".join(f"count(*) FILTER (y = {i} AND p = {j}) AS n_{i}{j}" for i in (0, 1) for j in (0, 1)) + """,
    """ + ", ".join(f"count(*) FILTER ({c} = {i}) AS {name}_{i}" for c, name in (("y", "true"), ("p", "pred"))
                    for i in (0, 1)) + """
    FROM judged GROUP BY ALL) USING (strategy_order, strategy)"""))
def _(spark, sf_dir):
    return strategies.strategy_metrics(_grade_cells(spark, sf_dir))


@query("grade_breakdown", steps(BULK_SQL, JUDGED, """
  SELECT strategy_order, strategy, grade, count(*) AS n, count(*) FILTER (p = 0) AS pred_as_0,
    count(*) FILTER (p = 1) AS pred_as_1, round(avg((y = p)::INT), 6) AS accuracy,
    round(100.0 * count(*) FILTER (p = 0) / count(*), 6)::DOUBLE AS pct_as_0,
    round(100.0 * count(*) FILTER (p = 1) / count(*), 6)::DOUBLE AS pct_as_1
  FROM judged GROUP BY ALL"""))
def _(spark, sf_dir):
    return strategies.grade_breakdown(_grade_cells(spark, sf_dir))


@query("best_strategy", steps(BULK_SQL, JUDGED, """
  SELECT strategy, round(accuracy, 6) AS accuracy,
    CASE WHEN accuracy > 0.7 THEN 'good' WHEN accuracy > 0.5 THEN 'medium' ELSE 'low' END AS verdict
  FROM (SELECT strategy_order, strategy, avg((y = p)::INT) AS accuracy FROM judged GROUP BY ALL)
  ORDER BY accuracy DESC, strategy_order LIMIT 1"""))
def _(spark, sf_dir):
    return strategies.best_strategy(strategies.strategy_metrics(_grade_cells(spark, sf_dir)))


_GUESSES = ("guesses", f"""
  SELECT 'random' AS baseline, y, ({mix_sql('row_id', 42)} % 4)::INT AS p FROM bulk
  UNION ALL SELECT 'majority', y, (SELECT y FROM bulk GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) FROM bulk""")


@query("baseline_untrained", steps(BULK_SQL, _GUESSES, scores_sql("guesses", "baseline"), f"""
  SELECT baseline, {_SUMMARY}, 0.25::DOUBLE AS random_guess FROM class_scores GROUP BY ALL"""))
def _(spark, sf_dir):
    cells = model.baseline_predictions(bulk(spark, sf_dir), 4)
    return metrics.metrics_summary(cells, ("baseline",)).withColumn("random_guess", F.lit(1.0 / 4))


@query("argmax_softmax_conf", steps(LOGITS_SQL, """
  SELECT row_id, (list_position(logits, list_max(logits)) - 1)::INT AS p,
    round(list_max(probs), 6) AS confidence, round(probs[1], 6) AS prob_first,
    round(probs[y + 1], 6) AS prob_label, round(list_sum(probs), 6) AS prob_sum
  FROM (SELECT *, list_transform(logits, lambda v: exp(v) / list_sum(list_transform(logits, lambda w: exp(w)))) AS probs
    FROM logit_rows)"""))
def _(spark, sf_dir):
    rows = logit_rows(spark, sf_dir).withColumn("probs", softmax(F.col("logits")))
    return rows.select(
        "row_id", argmax(F.col("logits")).alias("p"), confidence(F.col("logits")).alias("confidence"),
        F.get("probs", F.lit(0)).alias("prob_first"), F.get("probs", F.col("y")).alias("prob_label"),
        F.aggregate("probs", F.lit(0.0), lambda a, v: a + v).alias("prob_sum"))


_NLL = "ln(list_sum(list_transform(logits, lambda v: exp(v)))) - logits[y + 1]"


@query("log_loss", steps(LOGITS_SQL, f"""
  SELECT count(*) AS n, round(avg({_NLL}), 6) AS log_loss FROM logit_rows"""))
def _(spark, sf_dir):
    return losses.log_loss(losses.class_losses(logit_rows(spark, sf_dir)))


_WEIGHTS = ("weights", f"""
  SELECT y AS label, count(*) AS n, (SELECT count(*) FROM logit_rows)::DOUBLE / ({CLASSES} * count(*)) AS balanced,
    CASE y WHEN 2 THEN 1.4 WHEN 3 THEN 1.5 ELSE 1 END::DOUBLE AS boost FROM logit_rows GROUP BY y""")


@query("weighted_log_loss", steps(LOGITS_SQL, _WEIGHTS, f"""
  SELECT count(*) AS n, round(sum(balanced * boost * ({_NLL})) / sum(balanced * boost), 6) AS log_loss
  FROM logit_rows JOIN weights ON y = label"""))
def _(spark, sf_dir):
    return losses.weighted_log_loss(losses.weigh(losses.class_losses(logit_rows(spark, sf_dir))))


@query("class_weights", steps(BULK_SQL, """
  SELECT y AS label, n, round(balanced, 6) AS balanced,
    round(balanced * CASE y WHEN 2 THEN 1.4 WHEN 3 THEN 1.5 ELSE 1 END, 6)::DOUBLE AS weight
  FROM (SELECT y, count(*) AS n, sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)) AS balanced
    FROM bulk GROUP BY y)"""))
def _(spark, sf_dir):
    return class_weights(bulk(spark, sf_dir), "y")


_CANDIDATES = (LOGITS_SQL, EPOCH_ROWS_SQL, scores_sql("epoch_rows", "run, epoch"), ("candidates", f"""
  SELECT * FROM (SELECT run, epoch, avg({_NLL}) AS eval_loss FROM epoch_rows GROUP BY ALL)
  JOIN (SELECT run, epoch, sum(f1 * support) / sum(support) AS f1_weighted FROM class_scores GROUP BY ALL)
  USING (run, epoch)"""))


def _candidates(spark, sf_dir):
    return model.candidate_metrics(epoch_rows(spark, sf_dir), ("run", "epoch"))


@query("best_candidate", steps(*_CANDIDATES, """
  SELECT run, (SELECT epoch FROM candidates d WHERE d.run = c.run ORDER BY eval_loss, epoch LIMIT 1) AS best_epoch,
    round(min(eval_loss), 6) AS best_eval_loss FROM candidates c GROUP BY run"""))
def _(spark, sf_dir):
    return selection.best_candidate(_candidates(spark, sf_dir), "eval_loss", greater_is_better=False)


@query("best_candidate_f1", steps(*_CANDIDATES, """
  SELECT run, (SELECT epoch FROM candidates d WHERE d.run = c.run
      ORDER BY round(f1_weighted, 9) DESC, epoch LIMIT 1) AS best_epoch,
    round(max(f1_weighted), 6) AS best_f1_weighted FROM candidates c GROUP BY run"""))
def _(spark, sf_dir):
    scored = _candidates(spark, sf_dir).withColumn("f1_weighted", F.round("f1_weighted", 9))
    return selection.best_candidate(scored, "f1_weighted", greater_is_better=True)


@query("early_stop_epoch", steps(*_CANDIDATES, """
  SELECT c.run, min(epoch) FILTER (epoch - best >= 2) AS stop_epoch, max(epoch) AS last_epoch FROM (
    SELECT run, epoch, (SELECT d.epoch FROM candidates d WHERE d.run = c.run AND d.epoch <= c.epoch
      ORDER BY d.eval_loss, d.epoch LIMIT 1) AS best FROM candidates c) c GROUP BY c.run"""))
def _(spark, sf_dir):
    return selection.early_stop(_candidates(spark, sf_dir), "eval_loss", greater_is_better=False, patience=2)
