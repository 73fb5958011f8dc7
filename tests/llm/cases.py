"""Small awkward tables shared by the tests."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

# Columns whose names clash with those the operators use inside.
CLASHES = ("tag", "n", "size", "words", "target", "node", "kind", "n_words", "spans", "base", "score", "label", "places", "gram", "key")


def awkward(spark, docs, parts=3, schema="doc_id long, text string"):
    """The rows with further columns of clashing names, in several partitions."""
    df = spark.createDataFrame(docs, schema).repartition(parts)
    return df.withColumns({c: F.lit(f"not {c}") for c in CLASHES})


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def passages(seed=5, n=60):
    """Documents that share passages, with ties, copies, NULLs and long runs."""
    rng = random.Random(seed)
    words = ["ab", "cde", "fghi", "xy", "zz", "hello", "thon"]

    def sentence(k):
        return " ".join(rng.choice(words) for _ in range(k))

    base = [sentence(60) for _ in range(6)]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.4:
                b = rng.choice(base)
                s = rng.randint(0, len(b) - 1)
                parts.append(b[s:s + rng.randint(1, 200)])
            else:
                parts.append(sentence(rng.randint(1, 40)))
        docs.append((rng.randint(0, n + 10), "".join(parts)))
    return docs + [(5, "a" * 300), (2, "a" * 170), (99, "é" * 100), (98, "é" * 60), (None, base[0]), (200, None), (201, ""),
                   (202, base[0]), (202, base[0]), (202, base[1])]


def near(seed=3, n=200):
    """Groups of near copies, a common line, repeated ids, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(6)]
    line = "common line of many words here again and again"
    docs = []
    for _ in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(words)
        text = " ".join(b)
        if rng.random() < 0.4:
            text = line + "\n" + text
        if rng.random() < 0.1:
            text = line
        docs.append((rng.randint(0, n - 20), text))
    return docs + [(None, docs[0][1]), (500, None), (501, ""), (502, "a b"), (503, "A B"), (504, "a  b"), (505, "A b c d E"), (506, "a b c d e")]
