import random
import re

from pyspark.sql import functions as F

import brute
from cases import awkward, empty, rows
from scoreloom.llm import decontaminate

ITEMS = "item_id long, text string"


def tables(seed=4):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(40)] + ["été", "ß", "Über"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    items = [(i, text(rng.choice([1, 3, 12, 13, 14, 30]))) for i in range(12)]
    items += [(0, items[5][1]), (50, items[5][1].upper()), (51, None), (52, ""), (53, "..."), (None, text(20)), (54, "never seen words")]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1] or ""
            parts += [w if rng.random() < 0.6 else w[:len(w) // 2], text(rng.randint(0, 20))]
        docs.append((rng.randint(0, 50), "-".join(parts)))
    return docs + [(None, items[3][1]), (60, None), (61, ""), docs[0], docs[1]], items


def result(docs, items):
    return rows(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "item_ids", "contaminated")


def test_against_brute_force(spark):
    docs, items = tables()
    expected = sorted(brute.contaminated(docs, items), key=repr)
    assert any(e[4] for e in expected) and any(0 < e[2] and not e[4] for e in expected)
    assert result(awkward(spark, docs), awkward(spark, items, 2, ITEMS)) == expected


def test_clean_keeps_the_rest(spark):
    docs, items = tables(seed=9)
    bad = [e[4] for e in brute.contaminated(docs, items)]
    df = awkward(spark, docs)
    kept = decontaminate.clean(df, awkward(spark, items, 2, ITEMS))
    assert kept.columns == df.columns
    assert rows(kept, "doc_id", "text") == sorted((d for d, b in zip(docs, bad) if not b), key=repr)


def test_empty_tables(spark):
    docs, items = tables()
    assert result(empty(spark), awkward(spark, items, 2, ITEMS)) == []
    found = result(awkward(spark, docs), empty(spark, ITEMS))
    assert len(found) == len(docs) and not any(r[2] for r in found)


def test_proximity(spark):
    df = spark.createDataFrame([(1, "x c b y a z"), (2, "a b"), (3, "c a f f f f f b")], "doc_id long, text string")
    windows = decontaminate.test_windows(spark.createDataFrame([(1, "a b c")], ITEMS))
    terms = windows.select(decontaminate.F.explode("window").alias("term")).distinct()
    anchors = decontaminate.rarest_terms(windows, decontaminate.term_counts(df, terms))
    index = decontaminate.postings(df, anchors.select("term").distinct(), 12)
    assert {r["doc_id"] for r in decontaminate.proximity_matches(index, anchors, 4).collect()} == {1}
    assert {r["doc_id"] for r in decontaminate.proximity_matches(index, anchors, 7).collect()} == {1, 3}


def test_words_of_every_sign(spark):
    text = "".join(f"Q{chr(i)}z " for i in range(0x3000) if chr(i) not in "Qz ") + "\U0001F600A \U00010400"
    df = spark.createDataFrame([(1, text), (2, "İKK Σ AΣ."), (3, None)], "doc_id long, text string")
    found = df.orderBy("doc_id").select(decontaminate.words(F.col("text")), decontaminate.n_words(F.col("text"))).collect()
    for (got, n), t in zip(found, [text, "İKK Σ AΣ.", ""]):
        assert got == re.findall(brute.WORD, brute.low(t)) and n == len(got)


def test_texts_are_read_without_ranges_or_translation(spark):
    """Ranges in a class and ``translate`` cost several times the rest, for each character of all texts."""
    docs = spark.createDataFrame([(1, "A b, a")], "doc_id long, text string")
    terms = spark.createDataFrame([("a",)], "term string")
    for df in (decontaminate.term_counts(docs, terms), decontaminate.postings(docs, terms, 2), docs.select(decontaminate.n_words(F.col("text")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        classes = re.findall(r"regexp_\w+\(.*?(\[.*?\]\+)", plan)
        assert classes and not any("-" in c for c in classes)
        assert not re.search(r"translate\((cast\(|coalesce\()*text", plan)
    assert [tuple(r) for r in decontaminate.term_counts(docs, terms).collect()] == [("a", 2)]
    assert sorted((r["position"], r["ahead"], r["around"]) for r in decontaminate.postings(docs, terms, 2).collect()) == [
        (1, 0, ["a", "b", "a"]), (3, 2, ["a", "b", "a"])]
