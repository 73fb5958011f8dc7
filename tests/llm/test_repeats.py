from pyspark.sql import functions as F

import brute
import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, empty, passages, rows
from scoreloom.llm import suffix_dedup


def result(df):
    out = suffix_dedup.remove_repeats(df)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows(out, "doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256))


def test_against_brute_force(spark):
    docs = passages()
    assert result(awkward(spark, docs)) == sorted(brute.repeats(docs), key=repr)


def test_small_levels_and_hot_anchors(spark, monkeypatch):
    for name, value in (("HOT_LOCAL", 2), ("HOT_BUCKET", 3), ("LEVEL_ROWS", 30), ("GATHER_BYTES", 2000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = passages(seed=8)
    assert result(awkward(spark, docs, 5)) == sorted(brute.repeats(docs), key=repr)


def test_whole_table(spark, sf_dir, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert result(spark.read.parquet(f"{sf_dir}/documents.parquet")) == sorted(brute.repeats(docs), key=repr)


def test_hot_ids(spark, monkeypatch):
    # A third of the rows without id, a third with one id and text, one id with many texts; steps of a few copies.
    for name, value in (("COPIES", 7), ("REPEAT_BYTES", 4000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = passages(seed=4, n=40)
    long = docs[0][1] + docs[1][1] + "q" * 80
    docs += [(None, long)] * 60 + [(70, long)] * 100 + [(71, long[k:] + "r" * k) for k in range(30)] + [(72, None)] * 30
    assert result(awkward(spark, docs, 4)) == sorted(brute.repeats(docs), key=repr)


def test_identical_rows_travel_as_one(spark):
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 7, 8, 7, 9], "text": [b"a", b"a", b"a", None, b"b"], "tag": [1, 1, 1, 1, 2]})
    out = [r for b in suffix_dedup._counter()(iter([batch, batch])) for r in zip(*b.to_pydict().values())]
    total = {}
    for doc, text, _, n in out:
        total[doc, text] = total.get((doc, text), 0) + n
    assert total == {(7, b"a"): 4, (7, None): 2, (8, b"a"): 2, (9, b"b"): 2}
    assert [r[0] for r in out].count(7) == 2
    assert [b.num_rows for b in suffix_dedup._distinct(iter([batch]))] == [4]


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    raw = np.frombuffer(b"abcdefghij" * 3 + b"klmnopqrst" * 2, np.uint8)
    begin, doc = np.array([0, 10, 20, 30, 40]), np.array([3, 5, 3, 4, 9])
    expected = [1, 4]
    assert sorted(suffix_dedup.later_windows(raw, begin, doc, 10)) == expected
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda raw, begin, length: np.zeros(len(begin), np.uint64))
    assert sorted(suffix_dedup.later_windows(raw, begin, doc, 10)) == expected


def test_buckets_agree_with_spark(spark):
    rows_ = [(d, t) for d in (0, -5, 7, 1 << 40, -(1 << 62), (1 << 63) - 1) for t in (0, 1, 77, (1 << 32) - 1)]
    df = spark.createDataFrame(rows_, "d long, t long")
    got = [r[0] for r in df.select(suffix_dedup.bucket_column(F.col("d"), F.col("t"), 13)).collect()]
    d, t = (np.array(c) for c in zip(*rows_))
    assert got == suffix_dedup.doc_bucket(d, t.astype(np.uint32), 13).tolist()


def test_empty_table(spark):
    assert result(empty(spark)) == []


def test_gram_must_fit(spark):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(empty(spark), length=10, gram=12)
