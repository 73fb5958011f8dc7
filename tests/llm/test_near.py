import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, empty, near, rows
from scoreloom.llm import ngram_join
from scoreloom.llm.components import components


def result(df):
    return rows(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id")


def test_against_brute_force(spark):
    docs = near()
    assert result(awkward(spark, docs)) == sorted(brute.near_copies(docs), key=repr)


def test_long_and_salted_columns(spark, monkeypatch):
    for name, value in (("LONG", 6), ("HOT_LOCAL", 3), ("SALTS", 3), ("BLOCK", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = near(seed=11)
    assert result(awkward(spark, docs)) == sorted(brute.near_copies(docs), key=repr)


def test_whole_table(spark, sf_dir, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert result(spark.read.parquet(f"{sf_dir}/documents.parquet")) == sorted(brute.near_copies(docs), key=repr)


def test_empty_table(spark):
    assert result(empty(spark)) == []


def test_one_of_each(spark):
    docs = near(n=80)
    expected = {}
    components_of = brute.near_copies(docs)
    for (doc_id, text), (_, n, component) in zip(docs, components_of):
        if doc_id is None or n == 0:
            expected.setdefault(("alone", doc_id, text), []).append(text)
        else:
            expected.setdefault(component, []).append((doc_id, text))
    kept = rows(ngram_join.one_of_each(awkward(spark, docs)), "doc_id", "text")
    assert len(kept) == len(expected)
    for component, members in expected.items():
        if not isinstance(component, tuple):
            least = min(d for d, _ in members)
            assert sum((d, t) in members for d, t in kept) == 1
            assert any(d == least and (d, t) in members for d, t in kept)


def test_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(1000, 1001)], "a long, b long")
    found = dict(rows(components(links), "node", "component"))
    assert found == {i: 1 for i in range(1, 301)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("local", [0, 50, None])
def test_chains_of_any_order(spark, local):
    n = 3000
    shuffled = random.Random(4).sample(range(10_000, 10_000 + n), n)
    falling = [0, *range(n, 0, -1)]         # the least id at the end of a falling path
    links = [*zip(shuffled, shuffled[1:]), *zip(falling, falling[1:]), (-7, -7), (-5, -6), (-6, -5)]
    found = dict(rows(components(spark.createDataFrame(links, "a long, b long").repartition(3), local), "node", "component"))
    assert found == {i: 10_000 for i in shuffled} | {i: 0 for i in falling} | {-5: -6, -6: -6}


@pytest.mark.parametrize("small", [False, True])
def test_all_links_are_counted(spark, monkeypatch, small):
    if small:
        for name, value in (("LONG", 6), ("HOT_LOCAL", 3), ("SALTS", 3), ("BLOCK", 5), ("DENSE", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    docs = near(seed=12, n=400)
    different = {(i, t): brute.shingles(t) for i, t in docs if i is not None}

    def count(doc):
        mine = different.get(doc)
        return None if mine is None else sum(100 * len(mine & s) >= 80 * len(mine | s) for d, s in different.items() if d != doc and s) if mine else 0

    expected = sorted(((i, count((i, t))) for i, t in docs), key=repr)
    assert max(n for _, n in expected if n) > 30
    assert rows(ngram_join.near_duplicates(awkward(spark, docs)), "doc_id", "n_links") == expected


@pytest.mark.parametrize("long", [128, 2])
def test_few_common_passages_give_no_candidates(spark, monkeypatch, long):
    """Texts that share a passage are not compared any further, near copies are."""
    monkeypatch.setattr(ngram_join, "LONG", long)
    rng = random.Random(6)
    passage = [[f"p{k}x{j}" for j in range(20)] for k in range(20)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join([f"w{i}x{j}" for j in range(rng.randrange(180, 200))] + passage[i % 20])))
    docs += [(100 + i, t + " and more") for i, t in docs[:10]]
    seen, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda docs, signed, nodes, pairs, *rest: seen.append(pairs.count()) or links(docs, signed, nodes, pairs, *rest))
    found = dict(rows(ngram_join.near_duplicates(awkward(spark, docs)), "doc_id", "component_id"))
    assert found == {i: i % 100 for i, _ in docs}
    assert long == 2 or seen[0] <= 10      # long columns count as shared


def test_links_share_the_needed_columns(spark):
    rng = random.Random(2)
    sizes = {(n, m) for n in range(1, 60) for m in range(n, 5 * n // 4 + 1)} | {(400, 450), (399, 400), (500, 500), (800, 1000)}
    needed = {(r["na"], r["nb"]): r["k"] for r in spark.createDataFrame(sorted(sizes), "na long, nb long").select(
        "na", "nb", ngram_join._needed(ngram_join.SHARE).alias("k")).collect()}
    for n, m in sizes:
        least = -(-80 * (n + m) // 180)
        if least > n:
            continue
        for _ in range(5):
            order = rng.sample(range(n + m - least), n + m - least)
            x, y = order[:n], order[:least] + order[n:]
            if rng.random() < 0.5:         # what is not common comes first
                x, y = [(i in set(order[:least]), i) for i in x], [(i in set(order[:least]), i) for i in y]
            early = [set(p[:min(s - ngram_join._least(s, (80, 100)) + 1, s - least + ngram_join.SHARED)]) for p, s in ((sorted(x), n), (sorted(y), m))]
            assert len(early[0] & early[1]) >= needed[n, m] >= 1


def test_sketches_never_show_more_than_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 450, 520, 900, 3000):
        for apart in (0, 1, n // 9, n // 2, n):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate((x[apart:], rng.integers(0, 1 << 63, apart // 2, dtype=np.uint64)))
            sizes = np.array([len(x), 0, len(y)])
            first, none, second = (np.frombuffer(b, np.uint64) for b in ngram_join._sketches(np.concatenate((x, y)), sizes))
            assert not none.any() and [len(s) == ngram_join.SKETCH[k >= ngram_join.LARGE] for s, k in zip((first, second), (len(x), len(y)))] == [True, True]
            if len(first) != len(second):
                first, second = (s if len(s) == ngram_join.SKETCH[0] else ngram_join._narrow(s[None])[0] for s in (first, second))
            seen = int(np.bitwise_count(first ^ second).sum())
            assert seen <= apart + apart // 2 and (seen > 0 or apart == 0)


@pytest.mark.parametrize("own", [150, 700])
def test_unlike_sets_that_share_columns_yield_no_pairs(spark, monkeypatch, own):
    """Pairs out of the product follow the near copies, not the square of the texts that share a passage."""
    rng = random.Random(8)
    passage = [f"p{j}" for j in range(own // 3)]
    docs = [(i, " ".join([f"w{i}x{j}" for j in range(own + rng.randrange(10))] + passage)) for i in range(40)]
    docs += [(100 + i, t + " and more") for i, t in docs[:10]]
    made, keep = [], ngram_join.stored

    def stored(df, name):
        out = keep(df, name)
        if name == "products":
            made.append(out.select("a", "b").distinct().count())
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    # Without counts, columns of the passage are as early as others.
    monkeypatch.setattr(ngram_join, "frequent_grams", lambda *_: np.zeros(0, np.uint64))
    found = dict(rows(ngram_join.near_duplicates(awkward(spark, docs)), "doc_id", "component_id"))
    assert found == {i: i % 100 for i, _ in docs}
    assert made[0] <= 20


def test_a_spread_column_stays_marked():
    """An unmarked entry of an equal set does not hide that the rest of the column is elsewhere."""
    def block(node, salted):
        k = len(node)
        return ngram_join.pack(nodes=np.array(node), n=np.full(k, 50, np.uint32), many=np.ones(k, np.uint32), gram=np.full(k, 9, np.uint64),
                               at=np.zeros(k, np.uint32), salted=np.array(salted, np.uint8))

    blocks = pa.table({"block": pa.array([block([7], [2]), block([7, 8], [0, 0])], pa.binary())})
    found = ngram_join._shared_columns((pa.scalar(3, pa.int32()),), blocks).to_pylist()
    assert [(r["part"], r["node"], r["salted"]) for r in found] == [(3, 7, True), (3, 8, True)]
