import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import model, serving

WEIGHTS = np.array([[1.0, -2.0, 0.5], [0.0, 1.0, 1.0], [-1.0, 0.5, 2.0]])
BIAS = np.array([0.1, 0.0, -0.2])
BLOB = serving.linear_bytes(WEIGHTS, BIAS)


def served(df, features="v", width=3, **how):
    return serving.apply_model(df, BLOB, F.col(features), width, **how)


def test_equals_the_model_on_the_matrix(spark):
    rows = np.random.default_rng(4).normal(size=(300, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, v array<double>").repartition(5)
    expected = rows @ WEIGHTS.T + BIAS
    for batch in (7, 1024):
        got = served(df, batch=batch).orderBy("id").collect()
        assert np.allclose([r["logits"] for r in got], expected)
        assert [r["p"] for r in got] == expected.argmax(axis=1).tolist()
        e = np.exp(expected - expected.max(axis=1, keepdims=True))
        assert np.allclose([r["confidence"] for r in got], (e / e.sum(axis=1, keepdims=True)).max(axis=1))


def test_unusable_features_keep_their_row(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, None), (3, []), (4, [1.0, 2.0]), (5, [1.0, None, 3.0]), (6, [1.0, float("nan"), 3.0]),
            (1, [1.0, 2.0, 3.0]), (None, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumns({
        "logits": F.lit("old"), "p": F.lit("old"), "confidence": F.lit("old"), "odd.name": F.lit(1)})
    out = served(df)
    assert out.columns == ["id", "v", "odd.name", "logits", "p", "confidence"]
    got = sorted((r["id"] or 0, r["p"], r["logits"] is None, r["confidence"] is None) for r in out.where("p IS NOT NULL").collect())
    assert got == [(0, 0, False, False), (1, 2, False, False), (1, 2, False, False)]
    rest = out.where("p IS NULL").orderBy("id").collect()
    assert [(r["id"], r["logits"], r["confidence"]) for r in rest] == [(i, None, None) for i in range(2, 7)]


def test_empty_table(spark):
    assert served(spark.createDataFrame([], "id long, v array<float>")).collect() == []


def test_null_and_empty_texts_have_features(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "a b", "a b c"), (4, "a b " * 5000, None)],
                               "id long, student_answer string, reference_answer string")
    ready = model.pair_features(df).select("id", F.array("overlap", "log_student", "log_reference").alias("v"))
    got = {r["id"]: r for r in served(ready).collect()}
    assert got[1]["logits"] == got[2]["logits"] == pytest.approx(BIAS.tolist())
    assert got[3]["logits"] == pytest.approx((WEIGHTS @ [2 / 3, np.log(4), np.log(6)] + BIAS).tolist())
    assert got[4]["p"] is not None


def test_stored_and_foreign_files(spark, tmp_path):
    serving.store_model(spark, BLOB, str(tmp_path / "table"))
    assert serving.stored_model(spark, str(tmp_path / "table")) == BLOB
    (tmp_path / "made.npz").write_bytes(BLOB)
    assert serving.model_file(spark, str(tmp_path / "made.npz")) == BLOB


def test_other_loaders_run_once_per_worker(spark):
    def steps(blob):
        top = float(blob)
        return lambda rows: np.stack([rows.sum(axis=1), np.full(len(rows), top)], axis=1)

    df = spark.createDataFrame([(1, [1.0, 1.0]), (2, [9.0, 1.0])], "id long, v array<double>")
    got = serving.apply_model(df, b"5", F.col("v"), 2, load=steps).orderBy("id").collect()
    assert [r["p"] for r in got] == [1, 0]


def test_bounds_and_wrong_models(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 1.0, 1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="logits of shape"):
        serving.apply_model(df, b"", F.col("v"), 3, load=lambda blob: lambda rows: rows[:, 0]).collect()
    with pytest.raises(ValueError, match="do not belong"):
        serving.linear_bytes(WEIGHTS, BIAS[:2])
    (tmp_path / "made.npz").write_bytes(BLOB)
    monkeypatch.setattr(serving, "MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="at most 10"):
        serving.model_file(spark, str(tmp_path / "made.npz"))
    with pytest.raises(ValueError, match="at most 10"):
        served(df)
