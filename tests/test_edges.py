"""Hand-written rows at the limits of each operator."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom.functions.bins import LENGTH_BINS, RATIO_BINS, bands
from scoreloom.functions.grades import normalise_grade
from scoreloom.functions.probability import argmax, confidence, negative_log_likelihood, softmax
from scoreloom.operators import cleaning, encoding, labels, ledger, lengths, losses, metrics, model, prompts, selection
from scoreloom.operators.weights import class_weights
from scoreloom.schema import GRADED_SCHEMA
from scoreloom.sinks import report


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("length, label", [
    (0, None), (1, "0-50"), (50, "0-50"), (51, "50-100"), (100, "50-100"), (1000, "500-1000"), (1001, ">1000")])
def test_bins_are_right_closed(spark, length, label):
    assert one(spark, b=LENGTH_BINS.label(LENGTH_BINS.index(F.lit(length))))["b"] == label


def test_bin_of_null(spark):
    assert one(spark, b=LENGTH_BINS.index(F.lit(None).cast("int")))["b"] is None
    assert one(spark, b=RATIO_BINS.index(F.lit(None).cast("double")))["b"] is None


def test_bins_need_matching_labels():
    with pytest.raises(ValueError):
        bands((0, 1, 2), ("only one",))
    with pytest.raises(ValueError):
        bands((0, 2, 1), ("a", "b"))


@pytest.mark.parametrize("text, grade", [
    ("2", "2"), ("2.0", "2"), (" 5", "5"), ("5 ", "5"), ("05", "5"), ("4.5", "4.5"), ("зачёт", "зачёт"),
    ("", None), ("NA", None), ("nan", None), ("0", "0"), ("100", "100")])
def test_grade_spelling(spark, text, grade):
    assert one(spark, g=normalise_grade(F.lit(text)))["g"] == grade


def graded(spark, rows):
    return spark.createDataFrame(rows, GRADED_SCHEMA)


def test_drop_incomplete(spark):
    df = graded(spark, [
        (1, "q", "r", "s", "2.0"), (2, "q", "r", "s", "NA"), (3, "q", "r", "s", None), (4, None, "r", "s", "3"),
        (5, "q", "NULL", "s", "3"), (6, "q", "r", "", "3"), (7, "q", "r", "s", " 5"), (8, "q", "r", "s", "")])
    assert {(r["row_id"], r["grade"]) for r in cleaning.drop_incomplete(df).collect()} == {(1, "2"), (7, "5")}
    with pytest.raises(ValueError):
        cleaning.drop_incomplete(df.drop("grade"))


def test_unseen_class_stops_the_job(spark):
    df = spark.createDataFrame([("1",), ("2",)], "grade string")
    index = labels.FOUR_GRADE_INDEX
    assert {r["class"]: r["n"] for r in labels.unseen_classes(df, index).collect()} == {"1": 1}
    with pytest.raises(PySparkException, match="unseen class: 1"):
        df.select(index.encode_strict(F.col("grade"))).collect()


def test_many_classes_are_encoded_by_a_join(spark):
    df = spark.range(2000).select((F.col("id") % 1000).cast("string").alias("grade"))
    index = labels.fit_classes(df)
    assert isinstance(index, labels.ClassTable)
    more = df.unionByName(spark.createDataFrame([("new",), ("new",), (None,)], "grade string"))
    assert {r["class"]: r["n"] for r in labels.unseen_classes(more, index).collect()} == {"new": 2, None: 1}
    with pytest.raises(PySparkException, match="unseen class: "):
        labels.checked_labels(more, index).collect()
    got = {r["grade"]: r["label"] for r in labels.encode_labels(df).collect()}
    assert got == {g: i for i, g in enumerate(sorted(str(k) for k in range(1000)))}


def test_value_counts_skip_null(spark):
    df = spark.createDataFrame([("5",), ("2",), ("5",), (None,)], "grade string")
    assert [tuple(r) for r in labels.value_counts(df, "grade").collect()] == [("2", 1), ("5", 2)]


def test_ratio_of_empty_reference(spark):
    row = lengths.length_features(graded(spark, [(1, "q", "", "abc", "2")])).first()
    assert row["length_ratio"] is None and row["length_difference"] == 3


def test_empty_bins_survive(spark):
    df = spark.createDataFrame([(10, 0, 0), (20, 0, 1), (700, 1, 1), (0, 1, 1)], "answer_length int, y int, p int")
    got = {r["bin_label"]: (r["n"], r["accuracy"])
           for r in lengths.accuracy_by_bin(df, "answer_length", LENGTH_BINS).collect()}
    assert len(got) == 7
    assert got["0-50"] == (2, 0.5) and got["500-1000"] == (1, 1.0) and got[">1000"] == (0, None)


def test_best_and_worst_ignore_empty_bins_and_take_the_first(spark):
    df = spark.createDataFrame([(10, 0, 0), (60, 0, 0), (150, 0, 1)], "answer_length int, y int, p int")
    row = lengths.best_and_worst(lengths.accuracy_by_bin(df, "answer_length", LENGTH_BINS)).first()
    assert (row["best_bin"], row["worst_bin"]) == ("0-50", "100-200")


def test_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([(10, "2")] * 1 + [(10, "3")] * 399, "answer_length int, grade string")
    counts = lengths.crosstab(df, "answer_length", LENGTH_BINS, ("2", "3"))
    row = lengths.crosstab_percent(counts, ("2", "3")).first()
    assert (row["grade_2"], row["grade_3"]) == (0.2, 99.8)


def test_correlation_of_constant_column(spark):
    df = spark.createDataFrame([(5, 0.5, 1, 1), (5, 0.7, 2, 2)], "answer_length int, length_ratio double, y int, p int")
    row = lengths.length_correlation(df).first()
    assert row["corr_length_grade"] is None and row["corr_ratio_grade"] == pytest.approx(1.0)


def test_anova_of_one_group(spark):
    df = spark.createDataFrame([("2", 1), ("2", 3)], "grade string, answer_length int")
    row = lengths.anova(df).first()
    assert row["f"] is None and not row["significant"]


def test_logits(spark):
    tie = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    row = one(spark, p=argmax(tie), s=softmax(tie), c=confidence(tie), l=negative_log_likelihood(tie, F.lit(1)))
    total = math.exp(1) + 2 * math.exp(3)
    assert row["p"] == 1
    assert row["s"] == pytest.approx([math.exp(1) / total, math.exp(3) / total, math.exp(3) / total])
    assert row["c"] == pytest.approx(math.exp(3) / total)
    assert row["l"] == pytest.approx(math.log(total) - 3)


def test_large_logits_do_not_overflow(spark):
    x = F.array(F.lit(1000.0), F.lit(-1000.0))
    row = one(spark, s=softmax(x), l=negative_log_likelihood(x, F.lit(1)))
    assert row["s"] == [1.0, 0.0] and row["l"] == pytest.approx(2000.0)


def test_predicted_only_label_counts_for_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "y int, p int")
    row = metrics.metrics_summary(metrics.confusion_cells(df)).first()
    assert row["f1_macro"] == pytest.approx(1 / 3)
    report = {r["line"]: r for r in metrics.classification_report(metrics.confusion_cells(df)).collect()}
    assert report["1"]["support"] == 0 and report["1"]["f1"] == 0
    assert report["accuracy"]["f1"] == 0.5 and report["accuracy"]["precision"] is None
    assert report["weighted avg"]["recall"] == pytest.approx(0.5)


@pytest.mark.parametrize("predictions, collapsed", [
    ([0, 0, 0], True), ([1, 1, 1], True), ([0, 1, 1], False), ([0] + [1] * 11, True), ([0] + [1] * 10, False),
    ([0, 2], True)])
def test_collapse(spark, predictions, collapsed):
    df = spark.createDataFrame([(p,) for p in predictions], "p int")
    assert metrics.collapse_check(df, "p").first()["collapsed"] is collapsed


def test_full_matrix_with_missing_cells(spark):
    cells = metrics.confusion_cells(spark.createDataFrame([("a", 0, 2), ("b", 1, 1)], "run string, y int, p int"), by=("run",))
    grid = metrics.label_grid(cells, 3, ("run",)).collect()
    assert len(grid) == 18 and sum(r["n"] for r in grid) == 2
    wide = metrics.matrix_rows(cells.where("run = 'a'").drop("run"), 3).orderBy("y").collect()
    assert [tuple(r) for r in wide] == [(0, 0, 0, 1), (1, 0, 0, 0), (2, 0, 0, 0)]


def test_class_weights_average_to_one(spark):
    df = spark.createDataFrame([(0,)] * 7 + [(1,)] * 2 + [(2,)], "label int")
    rows = class_weights(df).collect()
    assert sum(r["n"] * r["balanced"] for r in rows) == pytest.approx(10)
    boosted = {r["label"]: r["weight"] / r["balanced"] for r in rows}
    assert boosted == pytest.approx({0: 1.0, 1: 1.0, 2: 1.4})


def test_weighted_loss(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 2.0], 1), ([1.0, 0.0], 1)], "logits array<double>, y int")
    nll = [math.log(2), math.log(math.exp(-2) + 1), math.log(math.e + 1)]
    parts = losses.class_losses(df)
    weights = spark.createDataFrame([(0, 3.0), (1, 0.5)], "label int, weight double")
    assert losses.log_loss(parts).first()["log_loss"] == pytest.approx(sum(nll) / 3)
    assert losses.weighted_log_loss(parts, weights).first()["log_loss"] == pytest.approx(
        (3 * nll[0] + 0.5 * nll[1] + 0.5 * nll[2]) / 4)
    assert losses.weighted_log_loss(parts).first()["log_loss"] == pytest.approx(sum(nll) / 3)


def test_early_stop(spark):
    series = {"falls": [5, 4, 3, 2], "rises": [1, 2, 3, 4], "tie": [2, 2, 2, 1], "late": [3, 2, 4, 1, 5, 6]}
    rows = [(run, e + 1, float(v)) for run, values in series.items() for e, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run string, epoch int, eval_loss double")
    got = {r["run"]: r["stop_epoch"] for r in selection.early_stop(df, "eval_loss", False, 2).collect()}
    assert got == {"falls": None, "rises": 3, "tie": 3, "late": 6}
    best = {r["run"]: r["best_epoch"] for r in selection.best_candidate(df, "eval_loss", False).collect()}
    assert best == {"falls": 4, "rises": 1, "tie": 4, "late": 4}
    best = {r["run"]: r["best_epoch"] for r in selection.best_candidate(df, "eval_loss", True).collect()}
    assert best == {"falls": 1, "rises": 4, "tie": 1, "late": 6}


def test_extreme_answers_break_ties_by_row(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 1, 1, 9, 9, 2, 1])], "row_id long, answer_length int")
    assert [r["row_id"] for r in ledger.extreme_answers(df, False, 3).collect()] == [1, 2, 6]
    assert [r["row_id"] for r in ledger.extreme_answers(df, True, 3).collect()] == [3, 4, 0]


def test_preview(spark):
    df = graded(spark, [(1, "q", "r", "я" * 100, "2"), (2, "q", "r", "ab", "2")])
    assert [r["answer_preview"] for r in ledger.with_preview(df).collect()] == ["я" * 80 + "...", "ab..."]


def test_augmentation_is_repeatable_and_independent_of_partitioning(spark):
    df = graded(spark, [(i, f"q{i}", f"r{i}", f"s{i}", "2") for i in range(500)])
    first = prompts.augmented_pair(df, epochs=2).select("row_id", "epoch", "template_id", "text_a", "text_b")
    again = prompts.augmented_pair(df.repartition(7), epochs=2).select(*first.columns)
    assert sorted(first.collect()) == sorted(again.collect())
    ids = [r["template_id"] for r in first.collect()]
    assert len(ids) == 1000 and set(ids) == set(range(-1, 7))
    assert 0.64 < sum(i >= 0 for i in ids) / len(ids) < 0.76
    moved = first.where("template_id = 5").first()
    assert moved["text_b"] == f"Студент: s{moved['row_id']} | Эталон: r{moved['row_id']}"


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(
        [(1, "a b", "c d e f"), (2, "a b c d e f", "c"), (3, "a b c d e", "c"), (4, "a, Б!", "x")],
        "row_id long, text_a string, text_b string")


def test_pair_encoding_cuts_only_the_second_text(spark, pairs):
    vocab = spark.createDataFrame([(4, "a", 9), (5, "b", 8), (6, "c", 7), (7, ",", 6)], "token_id int, token string, n long")
    ids = encoding.fit_token_ids(vocab)
    got = {r["row_id"]: r for r in encoding.pair_encode(pairs, ids, max_length=8).collect()}
    assert got[1]["input_ids"] == [2, 4, 5, 3, 6, 1, 1, 3]
    assert got[1]["token_type_ids"] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert got[2]["overflow"] and got[2]["input_ids"] is None and got[2]["attention_mask"] is None
    assert got[3]["input_ids"] == [2, 4, 5, 6, 1, 1, 3, 3] and got[3]["n_b"] == 0
    assert got[4]["input_ids"] == [2, 4, 7, 1, 1, 3, 1, 3]
    short = {r["row_id"]: r for r in encoding.pair_encode(pairs, ids, max_length=12).collect()}
    assert short[4]["input_ids"][8:] == [0] * 4 and short[4]["attention_mask"] == [1] * 8 + [0] * 4
    loose = {r["row_id"]: r for r in encoding.pair_encode(pairs, ids, max_length=12, pad=False).collect()}
    assert len(loose[4]["input_ids"]) == 8


def test_hashed_encoding_has_the_same_shape(spark, pairs):
    got = {r["row_id"]: r for r in encoding.pair_encode(pairs, 100, max_length=8).collect()}
    assert len(got[1]["input_ids"]) == 8 and got[2]["input_ids"] is None
    assert got[1]["input_ids"][4] == got[3]["input_ids"][3]


def test_vocabulary_breaks_ties_by_token(spark):
    df = spark.createDataFrame([("b a a",), ("b c!",)], "t string")
    rows = encoding.vocabulary(encoding.token_counts(df, "t"), 3).orderBy("token_id").collect()
    assert [tuple(r) for r in rows] == [(4, "a", 2), (5, "b", 2), (6, "!", 1)]


def test_unlisted_grades_are_counted(spark):
    df = spark.createDataFrame([(10, "2"), (20, "1"), (30, "1"), (40, None)], "answer_length int, grade string")
    counts = lengths.crosstab(df, "answer_length", LENGTH_BINS, ("2", "3"))
    row = counts.first()
    assert (row["grade_2"], row["grade_3"], row["grade_other"]) == (1, 0, 2)
    assert lengths.crosstab_percent(counts, ("2", "3")).first()["grade_2"] == 33.3


def test_no_grade_has_no_remapped_label(spark):
    df = spark.createDataFrame([("2",), (None,)], "grade string")
    found = {(r["grade"], r["strategy"]): r["binary_label"] for r in labels.remap(df).collect()}
    assert found["2", "strict"] == 0 and found[None, "strict"] is None


def test_a_class_without_weight_stops_the_job(spark):
    parts = spark.createDataFrame([(0, 2, 1.0), (1, 1, 3.0)], "label int, n long, loss_sum double")
    weights = spark.createDataFrame([(0, 1.0)], "label int, weight double")
    with pytest.raises(PySparkException, match="class without a weight: 1"):
        losses.weighted_log_loss(parts, weights).collect()


def test_describe_of_large_whole_numbers(spark):
    df = spark.range(1000).select(F.lit("g").alias("grade"), (F.col("id") + 10 ** 13).alias("answer_length"))
    row = lengths.describe(df).first()
    assert row["n"] == 1000 and row["mean"] == 10 ** 13 + 499.5
    assert row["std"] == pytest.approx(288.8194, rel=1e-3) and row["q2"] == 10 ** 13 + 499.5


def test_bincount_of_scattered_labels(spark):
    df = spark.createDataFrame([(3,), (3,), (0,), (100_000,), (None,)], "label int")
    found = metrics.bincount(df, "label")
    assert found.count() == 100_001
    assert {r["label"]: r["n"] for r in found.where("n > 0").collect()} == {0: 1, 3: 2, 100_000: 1}
    assert metrics.bincount(df.limit(0), "label").collect() == []


def test_the_best_candidate_is_returned_and_learns(spark):
    rows = [(i, "q", "water boils at hundred degrees", "it boils at hundred" if i % 2 else "the moon is cheese", str(2 + 3 * (i % 2)), i % 2)
            for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, question string, reference_answer string, student_answer string, grade string, label int")
    reg, chosen, candidates = model.best_model(df.where("row_id < 50"), df.where("row_id between 50 and 64"), (10.0, 0.01), size=1 << 8)
    assert candidates.count() == 2 and reg == 0.01
    scored = model.predict(chosen, df.where("row_id >= 65"))
    assert scored.where("p = label").count() == scored.count() == 15


def test_strategy_report_counts_every_grade(spark):
    listed = [("2", 0, 4), ("2", 1, 1), ("3", 0, 2), ("4", 1, 5), ("5", 1, 6)]

    def distribution(rows):
        cells = spark.createDataFrame(rows, "grade string, p int, n long")
        return report.strategy_report(cells, F.lit("run")).first()["original_distribution"]

    assert distribution(listed) == {"2": 5, "3": 2, "4": 5, "5": 6}
    assert distribution([*listed, ("1", 0, 7), (None, 1, 2)]) == {"2": 5, "3": 2, "4": 5, "5": 6, "other": 9}
