"""Training in epochs: early stop, the best model, going on from a stored one."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import model, selection
from scoreloom.operators.epochs import fit_epochs
from scoreloom.schema import REFERENCE, STUDENT

WORDS = ["red", "blue", "green", "stone", "river", "cloud", "table", "paper"]


def answers(spark, n, seed, noise=0.1):
    """Answers that hold a telling word per class, some under a wrong label."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.randrange(3)
        words = [f"class{label}"] + [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), "red river", rng.randrange(3) if rng.random() < noise else label))
    return spark.createDataFrame(rows, f"row_id long, {STUDENT} string, {REFERENCE} string, label int")


def loss(fitted, rows):
    scored = model.predict(fitted, rows).withColumnRenamed("label", "y").withColumn("run", F.lit(1))
    return model.candidate_metrics(scored, ("run",)).first()


def test_the_best_epoch_is_returned(spark):
    train, validation = answers(spark, 300, 1, 0.3), answers(spark, 200, 2, 0.3)
    fit = fit_epochs(train, validation, classes=3, epochs=12, steps=8, patience=2, size=64)
    history = fit.history.withColumn("run", F.lit("x")).orderBy("epoch")
    losses = [r["eval_loss"] for r in history.collect()]
    assert fit.best_epoch == 1 + losses.index(min(losses))
    assert selection.best_candidate(history, "eval_loss", False).first()["best_epoch"] == fit.best_epoch
    assert selection.early_stop(history, "eval_loss", False, 2).first()["stop_epoch"] == fit.stop_epoch
    # It overfits, so the last epoch is not the best, and the model is not the last one.
    assert fit.stop_epoch is not None and fit.best_epoch < fit.stop_epoch
    assert loss(fit.model, validation)["eval_loss"] == pytest.approx(min(losses), rel=1e-9)


def test_going_on_beats_starting_anew(spark, tmp_path):
    first, more, held_out = answers(spark, 400, 3), answers(spark, 60, 4), answers(spark, 300, 5)
    earlier = fit_epochs(first, held_out, classes=3, epochs=4, steps=5, size=64).model
    model.save_model(earlier, str(tmp_path / "earlier"))
    how = dict(classes=3, epochs=1, steps=2, size=64)
    warm = fit_epochs(more, held_out, start=model.load_model(str(tmp_path / "earlier")), **how)
    cold = fit_epochs(more, held_out, **how)
    assert loss(warm.model, held_out)["eval_loss"] < loss(cold.model, held_out)["eval_loss"]
    assert loss(warm.model, held_out)["accuracy"] > 0.8


def test_rows_without_text_or_label(spark):
    rows = answers(spark, 80, 6).unionByName(spark.createDataFrame(
        [(900, None, "red", 0), (901, "", "", 1), (902, "class1", None, None)], f"row_id long, {STUDENT} string, {REFERENCE} string, label int"))
    fit = fit_epochs(rows.withColumn("features", F.lit("not features")).drop("features"), rows, classes=3, epochs=1, steps=2, size=16)
    assert fit.history.first()["n"] == 82 and fit.stop_epoch is None
