"""Queries over model runs: five versions scored on the large table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import metrics, progress
from scoreloom.plans.adapters import RUNS, runs
from scoreloom.plans.evaluation import scores_sql
from scoreloom.plans.registry import query, steps

_BY = "run_order, run"
RUN_SCORES = (*RUNS, scores_sql("run_rows", _BY), ("run_scores", f"""
  SELECT {_BY}, sum(hits)::DOUBLE / sum(support) AS accuracy, avg(f1) AS f1_macro FROM class_scores GROUP BY ALL"""))
_RUN_PROGRESS = (*RUN_SCORES, ("run_progress", """
  SELECT run_order, run, 100 * accuracy AS accuracy_pct, 100 * f1_macro AS f1_macro_pct,
    100 * (accuracy - lag(accuracy) OVER w) AS accuracy_change, 100 * (f1_macro - lag(f1_macro) OVER w) AS f1_macro_change,
    lag(run) OVER w || '→' || run AS transition FROM run_scores WINDOW w AS (ORDER BY run_order)"""))
_CLASS_PROGRESS = (*RUNS, ("class_progress", """
  SELECT *, accuracy_pct - lag(accuracy_pct) OVER w AS change, lag(run) OVER w || '→' || run AS transition
  FROM (SELECT run_order, run, y, 100 * avg((y = p)::INT) AS accuracy_pct FROM run_rows GROUP BY ALL)
  WINDOW w AS (PARTITION BY y ORDER BY run_order)"""))


@query("runs_cells", steps(*RUNS, "SELECT run, run_order, y, p, n FROM runs"))
def _(spark, sf_dir):
    return runs(spark, sf_dir)


@query("run_metrics", steps(*RUN_SCORES, """
  SELECT run_order, run, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro FROM run_scores"""))
def _(spark, sf_dir):
    return progress.run_metrics(runs(spark, sf_dir))


@query("confusion_normalised", steps(*RUNS, """
  SELECT run_order, run, y, p, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY run, y), 6) AS share FROM runs"""))
def _(spark, sf_dir):
    return metrics.normalised_matrix(runs(spark, sf_dir), progress.RUN_KEYS).drop("annotation")


@query("confusion_annotated", steps(*RUNS, """
  SELECT run_order, run, y, p, n, round(s, 6) AS share, n::VARCHAR || ' (' || CASE WHEN y = p
      THEN printf('%.0f', round_even(100 * s, 0)) ELSE printf('%.1f', round_even(100 * s, 1)) END || '%)' AS annotation
  FROM (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY run, y) AS s FROM runs)"""))
def _(spark, sf_dir):
    return metrics.normalised_matrix(runs(spark, sf_dir), progress.RUN_KEYS)


@query("progress_runs", steps(*_RUN_PROGRESS, """
  SELECT run_order, run, transition, """ + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("accuracy_pct", "f1_macro_pct", "accuracy_change", "f1_macro_change"))
    + " FROM run_progress"))
def _(spark, sf_dir):
    return progress.run_progress(progress.run_metrics(runs(spark, sf_dir)))


@query("progress_classes", steps(*_CLASS_PROGRESS, """
  SELECT run_order, run, y, round(accuracy_pct, 6) AS accuracy_pct, round(change, 6) AS change, transition
  FROM class_progress"""))
def _(spark, sf_dir):
    return progress.class_progress(runs(spark, sf_dir))


@query("progress_significant", steps(*_CLASS_PROGRESS, """
  SELECT transition, y, round(change, 6) AS change FROM class_progress WHERE abs(change) > 0.1"""))
def _(spark, sf_dir):
    return progress.significant_changes(progress.class_progress(runs(spark, sf_dir))).select(
        "transition", "y", "change")


@query("progress_class_table", steps(*RUNS, "SELECT run_order, run, " + ", ".join(
    f"round(100 * avg((y = p)::INT) FILTER (y = {k}), 6) AS class_{k}" for k in range(4))
    + " FROM run_rows GROUP BY ALL"))
def _(spark, sf_dir):
    return progress.class_table(runs(spark, sf_dir), 4)


@query("progress_total", steps(*_CLASS_PROGRESS, """
  SELECT y, round(f, 6) AS first_pct, round(l, 6) AS last_pct, round(l - f, 6) AS total_change
  FROM (SELECT y, arg_min(accuracy_pct, run_order) AS f, arg_max(accuracy_pct, run_order) AS l
    FROM class_progress GROUP BY y)"""))
def _(spark, sf_dir):
    return progress.total_progress(progress.class_progress(runs(spark, sf_dir)), "accuracy_pct", ("y",))


@query("progress_total_runs", steps(*_RUN_PROGRESS, """
  SELECT metric, round(f, 6) AS first_pct, round(l, 6) AS last_pct, round(l - f, 6) AS total_change FROM (
    SELECT 'accuracy' AS metric, arg_min(accuracy_pct, run_order) AS f, arg_max(accuracy_pct, run_order) AS l FROM run_progress
    UNION ALL SELECT 'f1_macro', arg_min(f1_macro_pct, run_order), arg_max(f1_macro_pct, run_order) FROM run_progress)"""))
def _(spark, sf_dir):
    shown = progress.run_progress(progress.run_metrics(runs(spark, sf_dir)))
    long = shown.select("run_order", F.explode(F.create_map(
        F.lit("accuracy"), "accuracy_pct", F.lit("f1_macro"), "f1_macro_pct")).alias("metric", "pct"))
    return progress.total_progress(long, "pct", ("metric",))


@query("improvement_over_baseline", steps(*RUN_SCORES, """
  SELECT s.run_order, s.run, round(s.accuracy, 6) AS accuracy, round(s.f1_macro, 6) AS f1_macro,
    round(b.accuracy, 6) AS baseline_accuracy, round(b.f1_macro, 6) AS baseline_f1_macro,
    round(s.accuracy - b.accuracy, 6) AS improvement_accuracy, round(s.f1_macro - b.f1_macro, 6) AS improvement_f1_macro
  FROM run_scores s, (SELECT * FROM run_scores WHERE run = 'baseline') b WHERE s.run <> 'baseline'"""))
def _(spark, sf_dir):
    return progress.improvement_over(progress.run_metrics(runs(spark, sf_dir)), "baseline")
