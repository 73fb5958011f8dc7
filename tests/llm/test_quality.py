import random
import zlib

from pyspark.sql import functions as F

from cases import awkward, empty
from scoreloom.llm import quality


def texts(n=400):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("tion", "the", "an", "re", "ou") for b in ("er", "ing", "ed", "ly", "nd")]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        good = rng.random() < 0.7
        if not good:
            style = rng.randint(0, 2)
            w = [x.upper() + "!!" for x in w] if style == 0 else [x + rng.choice(["***", "$$$"]) for x in w] if style == 1 else " | ".join(w).split()
        out.append((i, " ".join(w), int(good)))
    return out


def tables(spark, rows):
    docs = awkward(spark, [(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "the end"), (0, rows[0][1])])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, rows[1][2]), (None, 1), (9002, None), (12345, 1)], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    rows = texts()
    docs, labels = tables(spark, rows)
    out = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(rows) + 4
    truth = {i: q for i, _, q in rows}
    right = total = 0
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is None:
            assert r["held_out"] is False
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in truth:
            total += 1
            right += r["predicted"] == truth[r["doc_id"]]
    assert total > 50 and right / total > 0.95


def test_held_out_labels_do_not_matter(spark):
    rows = texts(150)
    docs, labels = tables(spark, rows)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(tuple(r) for r in quality.score_quality(docs.where("doc_id < 9000"), quality.fit(docs, x)).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_no_labels_and_no_documents(spark):
    rows = texts(20)
    docs, labels = tables(spark, rows)
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(empty(spark), none).collect() == []


def test_keep_good_keeps_columns(spark):
    rows = texts()
    docs, labels = tables(spark, rows)
    model = quality.fit(docs, labels)
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    rejected = quality.score_quality(docs, model).where("predicted = 0").count()
    assert kept.count() == docs.count() - rejected
