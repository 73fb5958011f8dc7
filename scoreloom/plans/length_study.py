"""Answer-length queries on graded documents, and on the large table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scoreloom.functions.bins import BAND_NAMES, Bins, LENGTH_BINS, RATIO_BINS, bands
from scoreloom.operators import ledger, lengths
from scoreloom.operators.labels import FOUR_GRADE_INDEX
from scoreloom.plans.adapters import (
    ANSWERS_SQL, BULK_SQL, GRADED_SCORED, answer_lengths, bulk, graded_scored, grades, table, with_scores)
from scoreloom.plans.registry import query, steps
from scoreloom.schema import FOUR_GRADES


def bin_sql(value: str, bins: Bins) -> str:
    """CASE expression for the bin number, as text."""
    arms = []
    for i, (low, high) in enumerate(zip(bins.edges, bins.edges[1:])):
        upper = "" if math.isinf(high) else f" AND {value} <= {high}"
        arms.append(f"WHEN {value} > {low}{upper} THEN {i}")
    return "CASE " + " ".join(arms) + " END"


def bin_rows_sql(bins: Bins) -> tuple[str, str]:
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(bins.labels))
    return ("bins", f"SELECT * FROM (VALUES {rows}) b(bin_id, bin_label)")


def _per_bin(source: str, value: str, bins: Bins, select: str) -> tuple:
    return bin_rows_sql(bins), f"""
  SELECT b.bin_id, b.bin_label, count(s.row_id) AS n, {select}
  FROM bins b LEFT JOIN {source} s ON {bin_sql('s.' + value, bins)} = b.bin_id GROUP BY ALL"""


_ACCURACY = """round(avg((s.y = s.p)::INT), 6) AS accuracy, round(1 - avg((s.y = s.p)::INT), 6) AS error_rate"""


@query("length_features", steps(ANSWERS_SQL, """
  SELECT row_id, answer_length, reference_length, round(answer_length::DOUBLE / reference_length, 6) AS length_ratio,
    answer_length - reference_length AS length_difference
  FROM (SELECT row_id, length(student_answer) AS answer_length, length(reference_answer) AS reference_length FROM answers)"""))
def _(spark, sf_dir):
    return answer_lengths(spark, sf_dir).select(
        "row_id", F.col("answer_length").cast("bigint").alias("answer_length"),
        F.col("reference_length").cast("bigint").alias("reference_length"), "length_ratio",
        F.col("length_difference").cast("bigint").alias("length_difference"))


def _count_query(name, source, sql_source, value, bins):
    labels, body = _per_bin("src", value, bins, "1 AS one")
    sql = steps(*sql_source, labels, body.replace(", 1 AS one", ""))
    query(name, sql)(lambda spark, sf_dir: lengths.bin_counts(source(spark, sf_dir), value, bins))


_DOCS = (*GRADED_SCORED, ("src", "SELECT * FROM scored"))
_LINES = (BULK_SQL, ("src", "SELECT * FROM bulk"))

_ANSWERS = (ANSWERS_SQL, ("src", """
  SELECT *, answer_length::DOUBLE / nullif(reference_length, 0) AS length_ratio
  FROM (SELECT row_id, length(student_answer) AS answer_length, length(reference_answer) AS reference_length FROM answers)"""))
_count_query("length_bins", answer_lengths, _ANSWERS, "answer_length", LENGTH_BINS)
_count_query("ratio_bins", answer_lengths, _ANSWERS, "length_ratio", RATIO_BINS)
_count_query("bulk_length_bins", bulk, _LINES, "answer_length", LENGTH_BINS)


# Analysis of variance of ``src``; the lower tail is the power series of the incomplete beta function.
ANOVA_SQL = (("g", """
      SELECT grade, count(*) AS n, avg(answer_length) AS m, coalesce(var_samp(answer_length), 0) AS v FROM src GROUP BY grade"""),
    ("s", """SELECT sum(n)::BIGINT AS rows, count(*) - 1 AS df_between, (sum(n) - count(*))::BIGINT AS df_within,
        sum(n * (m - (SELECT avg(answer_length) FROM src)) ** 2) AS ss_between, sum((n - 1) * v) AS ss_within FROM g"""),
    ("t", "SELECT *, (ss_between / df_between) / (ss_within / df_within) AS f FROM s"),
    ("b", """SELECT *, df_between / 2.0::DOUBLE AS b1, df_within / 2.0::DOUBLE AS b2,
        df_between * f / (df_within + df_between * f) AS x FROM t"""),
    ("tail", """SELECT any_value(rows) AS rows, any_value(f) AS f, any_value(df_between) AS df_between,
          any_value(df_within) AS df_within, any_value(ss_between) AS ss_between, any_value(ss_within) AS ss_within,
          1 - sum(exp(b1 * ln(x) + b2 * ln(1 - x) - ln(b1) + lgamma(b1 + b2) - lgamma(b1) - lgamma(b2)
            + lgamma(b1 + b2 + k) - lgamma(b1 + b2) - lgamma(b1 + 1 + k) + lgamma(b1 + 1) + k * ln(x))) AS p
        FROM b, range(0, 20000) r(k)"""))


def _study(prefix, source, sql_source):
    """The part of the study that is the same for both tables."""

    for name, value, bins in (("accuracy_by_length", "answer_length", LENGTH_BINS),
                              ("accuracy_by_ratio", "length_ratio", RATIO_BINS)):
        query(prefix + name, steps(*sql_source, *_per_bin("src", value, bins, _ACCURACY)))(
            lambda spark, sf_dir, value=value, bins=bins: lengths.accuracy_by_bin(
                source(spark, sf_dir), value, bins))

    query(prefix + "confidence_by_length", steps(*sql_source, *_per_bin(
        "src", "answer_length", LENGTH_BINS, "round(avg(s.confidence), 6) AS confidence")))(
        lambda spark, sf_dir: lengths.mean_by_bin(
            source(spark, sf_dir), "answer_length", LENGTH_BINS, "confidence", "confidence"))

    query(prefix + "best_worst_bin", steps(*sql_source, bin_rows_sql(LENGTH_BINS), ("acc", f"""
      SELECT b.bin_id, b.bin_label, avg((s.y = s.p)::INT) AS a FROM bins b
      JOIN src s ON {bin_sql('s.answer_length', LENGTH_BINS)} = b.bin_id GROUP BY ALL"""), """
      SELECT (SELECT bin_label FROM acc ORDER BY a DESC, bin_id LIMIT 1) AS best_bin, round(max(a), 6) AS best_accuracy,
        (SELECT bin_label FROM acc ORDER BY a, bin_id LIMIT 1) AS worst_bin, round(min(a), 6) AS worst_accuracy FROM acc"""))(
        lambda spark, sf_dir: lengths.best_and_worst(lengths.accuracy_by_bin(
            source(spark, sf_dir), "answer_length", LENGTH_BINS)))

    for name, value, bins in (("length_crosstab", "answer_length", LENGTH_BINS),
                              ("ratio_crosstab", "length_ratio", RATIO_BINS)):
        counts = ", ".join(f"count(*) FILTER (grade = '{g}') AS grade_{g}" for g in FOUR_GRADES) + \
            f", count(*) FILTER (grade NOT IN {FOUR_GRADES}) AS grade_other"
        shares = ", ".join(f"round_even(100.0::DOUBLE * count(*) FILTER (grade = '{g}') / count(*), 1) AS grade_{g}"
                           for g in FOUR_GRADES)
        shares += f", round_even(100.0::DOUBLE * count(*) FILTER (grade NOT IN {FOUR_GRADES}) / count(*), 1) AS grade_other"
        labels = bin_rows_sql(bins)
        body = f"FROM src s JOIN bins b ON {bin_sql('s.' + value, bins)} = b.bin_id GROUP BY ALL"
        query(prefix + name, steps(*sql_source, labels, f"SELECT bin_id, bin_label, {counts} {body}"))(
            lambda spark, sf_dir, value=value, bins=bins: lengths.crosstab(
                source(spark, sf_dir), value, bins, FOUR_GRADES))
        query(prefix + name + "_pct", steps(*sql_source, labels, f"SELECT bin_id, bin_label, {shares} {body}"))(
            lambda spark, sf_dir, value=value, bins=bins: lengths.crosstab_percent(lengths.crosstab(
                source(spark, sf_dir), value, bins, FOUR_GRADES), FOUR_GRADES))

    query(prefix + "length_correlation", steps(*sql_source, """
      SELECT round(corr(answer_length, y), 6) AS corr_length_grade, round(corr(length_ratio, y), 6) AS corr_ratio_grade,
        round(corr(answer_length, p), 6) AS corr_length_predicted FROM src"""))(
        lambda spark, sf_dir: lengths.length_correlation(source(spark, sf_dir)))

    query(prefix + "anova_length", steps(*sql_source, *ANOVA_SQL, """
      SELECT rows, df_between, df_within, round(ss_between, 2) AS ss_between, round(ss_within, 2) AS ss_within,
        round(f, 6) AS f, round(p, 6) AS p, p < 0.05 AS significant FROM tail"""))(
        lambda spark, sf_dir: lengths.anova(source(spark, sf_dir)).withColumns({
            "ss_between": F.round("ss_between", 2), "ss_within": F.round("ss_within", 2)}))

    query(prefix + "grade_length_stats", steps(*sql_source, """
      SELECT grade, round_even(avg(answer_length), 1) AS length_mean, round_even(stddev_samp(answer_length), 1) AS length_std,
        min(answer_length)::INT AS length_min, max(answer_length)::INT AS length_max,
        round_even(avg(length_ratio), 1) AS ratio_mean, round_even(stddev_samp(length_ratio), 1) AS ratio_std,
        count(*) AS n FROM src GROUP BY grade"""))(
        lambda spark, sf_dir: lengths.grade_length_stats(source(spark, sf_dir)))

    for name, value in (("grade_length_describe", "answer_length"), ("grade_ratio_describe", "length_ratio")):
        query(prefix + name, steps(*sql_source, f"""
          SELECT grade, count(*) AS n, round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std,
            round(min({value})::DOUBLE, 6) AS min, round(max({value})::DOUBLE, 6) AS max,
            round(quantile_cont({value}, 0.25), 6) AS q1, round(quantile_cont({value}, 0.5), 6) AS q2,
            round(quantile_cont({value}, 0.75), 6) AS q3 FROM src GROUP BY grade"""))(
            lambda spark, sf_dir, value=value: lengths.describe(source(spark, sf_dir), "grade", value))

    for name, value in (("length_boxplot", "answer_length"), ("ratio_boxplot", "length_ratio")):
        query(prefix + name, steps(*sql_source, ("box", f"""
          SELECT grade, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2,
            quantile_cont({value}, 0.75) AS q3 FROM src GROUP BY grade"""), ("v", f"""
          SELECT *, {value}::DOUBLE AS v, {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM src JOIN box USING (grade)"""), """
          SELECT grade, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3,
            round(min(v) FILTER (inside), 6) AS whisker_low, round(max(v) FILTER (inside), 6) AS whisker_high,
            count(*) FILTER (NOT inside) AS outliers, count(*) AS n FROM v GROUP BY ALL"""))(
            lambda spark, sf_dir, value=value: lengths.boxplot(source(spark, sf_dir), value))

    query(prefix + "length_pred_density", steps(*sql_source, """
      SELECT grade, (p + 2)::VARCHAR AS predicted_grade, floor(answer_length / 100)::INT AS length_step, count(*) AS n
      FROM src GROUP BY ALL"""))(
        lambda spark, sf_dir: lengths.length_density(
            ledger.with_verdict(source(spark, sf_dir), FOUR_GRADE_INDEX), 100))


_study("", graded_scored, _DOCS)
_study("bulk_", bulk, _LINES)


@query("named_length_bands", steps(*_DOCS, ("e", """
  SELECT quantile_cont(answer_length, 0.25) AS q1, quantile_cont(answer_length, 0.5) AS q2,
    quantile_cont(answer_length, 0.75) AS q3 FROM src"""), ("bands", """
  SELECT *, CASE WHEN answer_length <= q1 THEN 0 WHEN answer_length <= q2 THEN 1 WHEN answer_length <= q3 THEN 2 ELSE 3 END AS bin_id
  FROM src, e"""), f"""
  SELECT bin_id, {list(BAND_NAMES)}[bin_id + 1] AS bin_label, count(*) AS n,
    round(avg((y = p)::INT), 6) AS accuracy, round(1 - avg((y = p)::INT), 6) AS error_rate FROM bands GROUP BY ALL"""))
def _(spark, sf_dir):
    rows = graded_scored(spark, sf_dir)
    edges = lengths.quartile_edges(rows, "answer_length")
    return lengths.accuracy_by_bin(rows, "answer_length", bands(edges, BAND_NAMES))


def _extreme_sql(direction):
    return steps(*GRADED_SCORED, f"""
  SELECT s.row_id, s.answer_length, s.grade, s.predicted_grade, s.grade = s.predicted_grade AS is_correct,
    left(g.student_answer, 80) || '...' AS answer_preview
  FROM scored s JOIN graded g USING (row_id) ORDER BY s.answer_length {direction}, s.row_id LIMIT 5""")


def _extremes(spark, sf_dir, longest):
    """Length and preview are taken at the scan; the join never moves a whole text."""
    previews = ledger.with_preview(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"),
                                                 F.col("text").alias("student_answer"),
                                                 F.length("text").cast("bigint").alias("answer_length"))
    ).drop("student_answer")
    scored = with_scores(grades(spark, sf_dir))
    judged = ledger.with_verdict(scored, FOUR_GRADE_INDEX).join(previews, "row_id")
    return ledger.extreme_answers(judged, longest).select(
        "row_id", "answer_length", "grade", "predicted_grade", "is_correct", "answer_preview")


@query("shortest_answers", _extreme_sql(""))
def _(spark, sf_dir):
    return _extremes(spark, sf_dir, longest=False)


@query("longest_answers", _extreme_sql("DESC"))
def _(spark, sf_dir):
    return _extremes(spark, sf_dir, longest=True)
