"""The paths that large inputs take, forced on small ones, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from scoreloom import session
from scoreloom.functions.hashing import mix
from scoreloom.operators import lengths, quantiles, splits
from scoreloom.operators.quantiles import exact_quantiles


def place_of(row_id, seed):
    """The order of rows inside a stratum, in plain Python."""
    if isinstance(row_id, str):
        return int(hashlib.md5(f"{row_id}:{seed}".encode()).hexdigest()[:8], 16)
    mask = 2 ** 32 - 1
    x = (row_id ^ (row_id >> 32) ^ seed) & mask
    x = ((x ^ (x >> 16)) * 0x7FEB352D) & mask
    x = ((x ^ (x >> 15)) * 0x6C8E9CF5) & mask
    return x ^ (x >> 16)


def expected_split(rows, keep, names, seed=42):
    """Largest-remainder sizes and hash order, in plain Python."""
    groups = {}
    for row_id, grade in rows:
        place = place_of(row_id, seed)
        groups.setdefault(grade, []).append((place, row_id))
    rest = {g: len(v) for g, v in groups.items()}
    cuts = {g: [] for g in groups}
    for share in keep:
        total = sum(rest.values())
        target = int(share * total + 1e-9)
        size = {g: n * target // total for g, n in rest.items()}
        order = sorted(rest, key=lambda g: (-(rest[g] * target % total), g))
        for g in order[:target - sum(size.values())]:
            size[g] += 1
        for g in rest:
            cuts[g].append((cuts[g][-1] if cuts[g] else 0) + size[g])
            rest[g] -= size[g]
    placed = {}
    for g, members in groups.items():
        for rank, (_, row_id) in enumerate(sorted(members), 1):
            part = next((names[i] for i, c in enumerate(cuts[g]) if rank <= c), names[-1])
            placed[row_id] = part
    return placed


ROWS = [(i, "5" if i % 3 else random.Random(i).choice("234")) for i in range(3000)] + [(9999, "1")]


@pytest.mark.parametrize("bucket_bits", [1, 6, 12, 20])
@pytest.mark.parametrize("plan", [splits.THREE_WAY, splits.TWO_WAY])
def test_split_equals_brute_force(spark, bucket_bits, plan):
    df = spark.createDataFrame(ROWS, "row_id long, grade string").repartition(5)
    got = splits.stratified_split(df, "grade", **plan, bucket_bits=bucket_bits)
    assert {r["row_id"]: r["split"] for r in got.collect()} == expected_split(ROWS, **plan)


def test_split_by_text_ids(spark):
    rows = [(f"id-{i}", g) for i, g in ROWS]
    df = spark.createDataFrame(rows, "row_id string, grade string")
    got = splits.stratified_split(df, "grade", **splits.THREE_WAY, bucket_bits=5)
    assert {r["row_id"]: r["split"] for r in got.collect()} == expected_split(rows, **splits.THREE_WAY)


def test_draws_are_even(spark):
    df = spark.range(-5000, 5000).withColumn("bucket", (mix(F.col("id"), 42) / 2 ** 32 * 10).cast("int"))
    counts = [r["count"] for r in df.groupBy("bucket").count().collect()]
    assert len(counts) == 10 and min(counts) > 880 and max(counts) < 1120


def test_split_sizes_are_exact(spark):
    df = spark.createDataFrame(ROWS, "row_id long, grade string")
    sizes = splits.split_sizes(splits.stratified_split(df, "grade", **splits.THREE_WAY), "grade")
    totals = {r["split"]: r["n"] for r in sizes.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"train": 2100, "val": 450, "test": 451}


def test_split_with_more_strata_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(splits, "settle", lambda df, **_: session.settle(df, max_rows=2))
    df = spark.createDataFrame(ROWS, "row_id long, grade string")
    got = splits.stratified_split(df, "grade", **splits.TWO_WAY, bucket_bits=5)
    assert {r["row_id"]: r["split"] for r in got.collect()} == expected_split(ROWS, **splits.TWO_WAY)


def test_rows_without_stratum_keep_no_split(spark):
    df = spark.createDataFrame([(1, "2"), (2, None), (3, "2")], "row_id long, grade string")
    got = {r["row_id"]: r["split"] for r in splits.stratified_split(df, "grade", **splits.TWO_WAY).collect()}
    assert got[2] is None and None not in (got[1], got[3])


def test_settle_above_the_bound_keeps_every_row(spark):
    df = spark.range(100).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n"))
    big, small = session.settle(df, max_rows=10), session.settle(df, max_rows=50)
    heavy = session.settle(df, max_rows=50, max_bytes=100)
    assert sorted(heavy.collect()) == sorted(small.collect())
    assert "BroadcastExchange" not in heavy.join(spark.range(9), F.col("k") == F.col("id")).hint("merge")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(big.collect()) == sorted(small.collect())
    assert "BroadcastExchange" in small.join(spark.range(9), F.col("k") == F.col("id"))._jdf.queryExecution().toString()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False) | st.sampled_from([0.0, 1.5]), min_size=1, max_size=300))
def test_quantiles_equal_brute_force(spark, values):
    rows = [("all", v) for v in values] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for accuracy, small in ((5, 0), (20_000, 0), (20_000, quantiles.SMALL)):
        got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "g", "v", probs, accuracy=accuracy, small=small).collect()}
        assert got["all"] == pytest.approx(np.quantile(values, probs), rel=1e-9, abs=1e-9)
    rows_of = quantiles._rows(df, "g", "v")
    got = {r["g"]: r["quantiles"] for r in quantiles._ranked_quantiles(rows_of, "g", probs, 5).collect()}
    assert got["all"] == pytest.approx(np.quantile(values, probs), rel=1e-9, abs=1e-9)
    assert got["two"] == pytest.approx([1.0, 1.25, 1.5, 1.75, 2.0])


def test_quantiles_of_a_bracketed_skewed_group(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.exponential(3.0, 20_000), np.full(9_000, 1.25)])
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double").repartition(6)
    values = np.concatenate([values, [1e300, -1e300, 0.0]])
    df = df.unionByName(spark.createDataFrame([("g", 1e300), ("g", -1e300), ("g", 0.0), ("g", None), ("g", float("nan"))], df.schema))
    probs = [0.25, 0.5, 0.75, 0.99]
    for steps in (1, 7, 1024):
        got = exact_quantiles(df, "g", "v", probs, accuracy=200, small=800, steps=steps).first()["quantiles"]
        assert got == pytest.approx(np.quantile(values, probs), rel=1e-12)


def test_brackets_hold_their_ranks(spark, monkeypatch):
    """From SMALL rows on, and for every smaller group, no quantile is looked for twice."""
    def missed(*_):
        raise AssertionError("a bracket missed its rank")

    monkeypatch.setattr(quantiles, "_ranked_quantiles", missed)
    rng = np.random.default_rng(5)
    groups = {str(n): rng.lognormal(3, 2, n) for n in (1, 2, 3, 4, 5, 7, 50, 399, 401, 1000)}
    groups["dominant"] = np.concatenate([rng.normal(0, 1, 15_000), np.full(5_000, 0.5)])
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    for r in exact_quantiles(df, "g", "v", probs, accuracy=100, small=400).collect():
        assert r["quantiles"] == pytest.approx(np.quantile(groups[r["g"]], probs), rel=1e-12)


def test_values_that_divide_badly(spark):
    values = [float("-inf"), -1.7e308, 0.0, 1.0, 1.7e308, float("inf"), float("inf")]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    assert exact_quantiles(df, "g", "v", [1 / 6, 1 / 3, 0.5, 2 / 3]).first()["quantiles"] == [-1.7e308, 0.0, 1.0, 1.7e308]


@pytest.mark.parametrize("kind", ["int", "double"])
def test_boxplot_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    values = {g: np.round(rng.lognormal(3, 1, 400)) for g in "25"}
    df = spark.createDataFrame([(g, float(v)) for g in values for v in values[g]], "grade string, v double").withColumn(
        "v", F.col("v").cast(kind))
    for row in lengths.boxplot(df, "v").collect():
        x = values[row["grade"]]
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (row["q1"], row["q2"], row["q3"]) == pytest.approx((q1, q2, q3))
        assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
        assert (row["outliers"], row["n"]) == (len(x) - len(inside), len(x))


def test_vocabulary_join_equals_lookup(spark):
    from scoreloom.operators import encoding

    rows = [(i, " ".join(random.Random(i).choices("abcdefgh", k=i)), " ".join(random.Random(-i).choices("ghijk", k=3 * i)), i % 3) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, text_a string, text_b string, label int")
    vocab = encoding.vocabulary(encoding.token_counts(df, "text_a", "text_b"), 6)
    by_list = encoding.pair_encode(df, encoding.fit_token_ids(vocab), 16)
    by_join = encoding.pair_encode(df, vocab, 16)
    columns = ["row_id", "label", "overflow", "input_ids", "token_type_ids", "attention_mask"]
    assert sorted(by_list.select(columns).collect()) == sorted(by_join.select(columns).collect())


def test_no_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
