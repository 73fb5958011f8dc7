"""Published numbers: from matrices and group statistics to metrics."""

import math

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.fdist import f_tail
from scoreloom.operators import lengths, metrics, progress, strategies
from scoreloom.sources.runs import runs_from_matrices

FOUR_CLASS = {
    "v1": [[50, 7, 4, 0], [7, 28, 24, 2], [3, 11, 35, 12], [0, 1, 18, 41]],
    "v2": [[49, 7, 5, 0], [9, 31, 20, 1], [3, 12, 35, 11], [0, 1, 19, 40]],
    "v3": [[71, 7, 3, 0], [5, 68, 9, 1], [0, 5, 64, 13], [0, 0, 20, 62]],
    "v4": [[71, 9, 1, 0], [5, 71, 6, 1], [0, 5, 66, 11], [0, 0, 19, 63]],
}
TWO_CLASS = {
    "first": [[63, 0], [2, 60]], "second": [[90, 4], [7, 87]],
    "strict": [[1584, 47], [1083, 562]], "liberal": [[807, 2], [1860, 607]],
    "middle": [[2230, 224], [437, 385]],
}
# run: rows, accuracy, macro F1, weighted F1
EXPECTED = {
    "v1": (243, 0.633745, 0.637742, 0.637432), "v2": (243, 0.637860, 0.642784, 0.642490),
    "v3": (328, 0.807927, 0.810681, 0.810468), "v4": (328, 0.826220, 0.827716, 0.827536),
    "first": (125, 0.984, 0.983991, 0.983994), "second": (188, 0.941489, 0.941474, 0.941474),
    "strict": (3276, 0.655067, 0.617878, 0.617369), "liberal": (3276, 0.431624, 0.429498, 0.411870),
    "middle": (3276, 0.798230, 0.704504, 0.787409),
}
# grade: rows, rows predicted as 1
GRADE_PREDICTIONS = {"2": (809, 2), "3": (822, 45), "4": (823, 177), "5": (822, 385)}
# rows, mean and deviation of the answer length per grade
GROUPS = [
    (162, 52.29012345679013, 21.413898690512216), (165, 65.55151515151515, 26.08719105853415),
    (165, 97.58181818181818, 43.8318673368479), (164, 130.91463414634146, 59.42747319046957),
]


def test_metrics_of_published_matrices(spark):
    cells = runs_from_matrices(spark, {**FOUR_CLASS, **TWO_CLASS})
    got = {r["run"]: (r["n"], r["accuracy"], r["f1_macro"], r["f1_weighted"])
           for r in metrics.metrics_summary(cells, ("run",)).collect()}
    assert set(got) == set(EXPECTED)
    for run, numbers in EXPECTED.items():
        assert got[run] == pytest.approx(numbers, abs=1e-6), run


@pytest.fixture(scope="module")
def grade_cells(spark):
    rows = [(g, p, n) for g, (total, ones) in GRADE_PREDICTIONS.items() for p, n in ((0, total - ones), (1, ones))]
    return spark.createDataFrame(rows, "grade string, p int, n long")


def test_strategies_from_grade_counts(grade_cells):
    got = {r["strategy"]: r for r in strategies.strategy_metrics(grade_cells).collect()}
    for name in ("strict", "liberal", "middle"):
        row, matrix = got[name], TWO_CLASS[name]
        assert [[row["n_00"], row["n_01"]], [row["n_10"], row["n_11"]]] == matrix
        assert (row["n"], row["accuracy"], row["f1_macro"], row["f1_weighted"]) == pytest.approx(
            EXPECTED[name], abs=1e-6)
        assert (row["pred_0"], row["pred_1"]) == (2667, 609)


def test_grade_breakdown(grade_cells):
    rows = strategies.grade_breakdown(grade_cells).where("strategy = 'middle'").collect()
    got = {r["grade"]: r for r in rows}
    for grade, (total, ones) in GRADE_PREDICTIONS.items():
        right = ones if grade == "5" else total - ones
        assert (got[grade]["n"], got[grade]["pred_as_1"]) == (total, ones)
        assert got[grade]["accuracy"] == pytest.approx(right / total)
        assert got[grade]["pct_as_0"] + got[grade]["pct_as_1"] == pytest.approx(100)


def test_best_strategy(grade_cells):
    best = strategies.best_strategy(strategies.strategy_metrics(grade_cells)).first()
    assert (best["strategy"], best["verdict"]) == ("middle", "good")


def test_anova_from_group_statistics(spark):
    groups = spark.createDataFrame(GROUPS, "n long, mean double, std double").withColumn(
        "variance", F.col("std") * F.col("std"))
    row = lengths.anova_from_groups(groups).first()
    assert row["f"] == pytest.approx(122.33313856485398, rel=1e-10)
    assert (row["df_between"], row["df_within"]) == (3, 652)
    assert row["p"] == pytest.approx(7.396002211239849e-63, rel=1e-12)
    assert row["significant"]


def tails(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f double, d1 double, d2 double")
    return [r["p"] for r in df.select("i", f_tail(F.col("f"), F.col("d1"), F.col("d2")).alias("p")).orderBy("i").collect()]


def test_f_tail(spark):
    known = [(0.0, 3, 10, 1.0), (1.0, 1, 1, 0.5), (4.0, 2, 2, 0.2), (1.0, 7, 7, 0.5), (2.0, 2, 10, 0.1859344320818717)]
    # Closed forms: two degrees on either side, one on both.
    for f in (1e-6, 0.03, 0.7, 1.0, 1.3, 9.0, 250.0):
        for d in (1.0, 2.0, 5.0, 40.0, 999.0, 1e6, 1e12):
            known.append((f, 2.0, d, math.exp(-d / 2 * math.log1p(2 * f / d))))
            known.append((f, d, 2.0, -math.expm1(-d / 2 * math.log1p(2 / (d * f)))))
        known.append((f, 1.0, 1.0, 2 / math.pi * math.atan(1 / math.sqrt(f))))
        # Very many rows: three degrees of a chi-squared distribution.
        y = 3 * f
        known.append((f, 3.0, 1e18, math.erfc(math.sqrt(y / 2)) + math.sqrt(2 * y / math.pi) * math.exp(-y / 2)))
    got = tails(spark, [tuple(map(float, k[:3])) for k in known])
    for k, p in zip(known, got):
        assert p == pytest.approx(k[3], rel=1e-10, abs=1e-300), k


def test_f_tail_of_a_ratio_and_its_inverse(spark):
    cases = [(f, d1, d2) for f in (0.2, 0.9, 1.0, 1.1, 4.0) for d1 in (1.0, 3.0, 8.0, 1e5) for d2 in (1.0, 6.0, 77.0, 1e6)]
    there, back = tails(spark, cases), tails(spark, [(1 / f, d2, d1) for f, d1, d2 in cases])
    for case, p, q in zip(cases, there, back):
        assert p + q == pytest.approx(1, abs=1e-9), case


def test_f_tail_without_groups(spark):
    nan, inf = float("nan"), float("inf")
    assert tails(spark, [(nan, 3.0, 5.0), (None, 3.0, 5.0), (1.0, 0.0, 5.0), (1.0, 3.0, -1.0), (1.0, None, 5.0), (inf, 3.0, 5.0), (-1.0, 3.0, 5.0)]) == [
        None, None, None, None, None, 0.0, 1.0]


def test_anova_stays_in_the_jvm(spark):
    groups = spark.createDataFrame(GROUPS, "n long, mean double, std double").withColumn("variance", F.col("std") * F.col("std"))
    plan = lengths.anova_from_groups(groups)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan



def test_version_progress(spark):
    cells = runs_from_matrices(spark, FOUR_CLASS)
    runs = {r["run"]: r for r in progress.run_progress(progress.run_metrics(cells)).collect()}
    assert runs["v1"]["transition"] is None and runs["v1"]["accuracy_change"] is None
    assert runs["v3"]["transition"] == "v2→v3"
    assert runs["v3"]["accuracy_change"] == pytest.approx(17.0, abs=0.05)
    assert runs["v4"]["accuracy_change"] == pytest.approx(1.8, abs=0.05)
    table = {r["run"]: r for r in progress.class_table(cells, 4).collect()}
    assert [round(table["v4"][f"class_{k}"] / 100, 3) for k in range(4)] == [0.877, 0.855, 0.805, 0.768]
    changes = progress.significant_changes(progress.class_progress(cells)).collect()
    assert all(abs(r["change"]) > 0.1 for r in changes)
    # Class 2 between v3 and v4 and class 4 between v1 and v2 did not change.
    assert {(r["transition"], r["y"]) for r in changes} == {
        ("v1→v2", 0), ("v1→v2", 1), ("v1→v2", 3), ("v2→v3", 0), ("v2→v3", 1), ("v2→v3", 2),
        ("v2→v3", 3), ("v3→v4", 1), ("v3→v4", 2), ("v3→v4", 3)}
    total = progress.total_progress(progress.class_progress(cells), "accuracy_pct", ("y",))
    assert {r["y"]: round(r["total_change"], 1) for r in total.collect()} == {0: 5.7, 1: 39.6, 2: 23.1, 3: 8.5}


def test_annotations(spark):
    cells = runs_from_matrices(spark, {"v1": FOUR_CLASS["v1"], "two": TWO_CLASS["first"]})
    text = {(r["run"], r["y"], r["p"]): r["annotation"]
            for r in metrics.normalised_matrix(cells, ("run_order", "run")).collect()}
    assert text["v1", 0, 0] == "50 (82%)" and text["v1", 0, 1] == "7 (11.5%)"
    assert text["two", 0, 0] == "63 (100.0%)" and text["two", 1, 0] == "2 (3.2%)"
