"""Divergence of sources, SentencePiece encoding, collocations."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from cases import awkward, empty, rows
from scoreloom.llm import collocations, divergence, sentence_pieces
from scoreloom.llm.textvec import flat

import pyarrow as pa

GROUPED = "doc_id long, lang string, source string, text string"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# --- divergence

def audited(docs, top, least):
    """All rows of the audit, from the definition."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]

        def shares(which):
            n = Counter()
            for g in which:
                n.update({t: counts[g][t] for t in kept})
            whole = sum(n.values())
            return {t: 1 + 10 ** 9 * (n[t] + 1) // (whole + len(kept)) for t in kept}

        p, q = shares([(lang, source)]), shares([g for g in groups if g[0] == lang])
        ranked = {"pair": [], "term": []}
        for g in groups:
            if g[0] == lang and g != (lang, source):
                other = shares([g])
                ranked["pair"].append((-sum((p[t] - other[t]) ** 2 // other[t] for t in kept), g[1].encode()))
        ranked["term"] = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t])[:top]
        for part, found in ranked.items():
            out += [(lang, source, part, item.decode(), -value, r + 1) for r, (value, item) in enumerate(sorted(found))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, bucket", [(128, 1 << 23), (2, 2000)])
def test_divergence(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(divergence, "GATHER", 3)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abÉzé" for b in "xyzÖ"] + ["Tie1tie", "日本", "a_b"]
    docs = [(i, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", "s3", None, "é"]),
             " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    docs += [(None, "en", "only", None), (1, "xx", "a", "lonely words"), (1, "xx", "b", ""), (1, "xx", "b", ""), (7, "en", "s1", "long " * 5000)]
    columns = ("lang", "source", "part", "item", "value", "rank")
    for top in (3, 200):
        got = rows(divergence.audit(awkward(spark, docs, 4, GROUPED), top), *columns)
        assert got == audited(docs, top, 3)
    assert divergence.audit(empty(spark, GROUPED)).collect() == []


def test_skyband_holds_every_first_k():
    rng = np.random.default_rng(2)
    for k in (1, 3, 20):
        n, whole = rng.integers(1, 9, 700), rng.integers(1, 12, 700)
        place = rng.permutation(700)
        kept = set(divergence.skyband(n, whole, place, k).tolist())
        over = (n[None, :] >= n[:, None]) & (whole[None, :] <= whole[:, None]) & (place[None, :] < place[:, None])
        assert kept == set(np.flatnonzero(over.sum(axis=1) < k).tolist())


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (5, 5, 1), (10 ** 13 - 7, 10 ** 13, 10 ** 7 + 3), (123456789, 10 ** 12 + 1, 999)]
    df = spark.createDataFrame(cases, "c long, t long, v long")
    assert rows(df, "c", divergence.share(F.col("c"), F.col("t"), F.col("v"))) == sorted(
        ((c, 1 + 10 ** 9 * (c + 1) // (t + v)) for c, t, v in cases), key=repr)


# --- SentencePiece

SIGNS = "ab  cdehint\n\t▁é́ﬁ①日本한국\x00<s>½Ａ　 .,1234567890😀​thein"


def variants():
    """The given model, and others with character maps and further settings."""
    given = sentence_pieces.read_model()
    yield given
    for rule, squeeze, fallback, prefix in (("nmt_nfkc", True, True, True), ("nfkc_cf", False, False, False), ("nmt_nfkc", True, False, True)):
        model, mapped = proto.ModelProto(), proto.ModelProto()
        model.ParseFromString(given)
        mapped.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = mapped.normalizer_spec.precompiled_charsmap
        model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, prefix
        model.trainer_spec.byte_fallback = fallback
        for piece in model.pieces:
            if piece.type == sentence_pieces.BYTE and not fallback:
                piece.type = sentence_pieces.CONTROL
        yield model.SerializeToString()


def test_encoding_equals_the_library(spark):
    rng = random.Random(1)
    texts = ["", " ", "  ", "▁x", "the the  the", None, "x" * 3000, "日" * 500, "a b " * 4000]
    texts += ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(250)]
    docs = [*enumerate(texts), (None, "again"), (3, "▁x")]
    for content in variants():
        library = sentencepiece.SentencePieceProcessor(model_proto=content)
        expected = []
        for doc_id, text in docs:
            pieces = library.encode(text or "", return_type="proto").pieces
            ids = library.encode(text or "", add_eos=True)
            spans = [(p.begin, p.end) for p in pieces] + [(len((text or "").encode()),) * 2]
            expected.append((doc_id, ids, [s[0] for s in spans], [s[1] for s in spans], library.decode(ids)))
        found = sentence_pieces.encode(awkward(spark, docs), content, decoded=True)
        assert rows(found, "doc_id", "ids", "begins", "ends", "text") == sorted(expected, key=repr)
        again = sentence_pieces.decode(found.drop("text"), content)
        assert rows(again, "doc_id", "text") == sorted(((e[0], e[4]) for e in expected), key=repr)
    assert sentence_pieces.encode(empty(spark), content).collect() == []


def test_decoding_of_any_ids(spark):
    content = sentence_pieces.read_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=content)
    rng = random.Random(2)
    lists = [[], [2], [1, 261], [0, 0, 261], [200, 100], [240 + 3], [28705, 28705, 261]] + [
        [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))] for _ in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "i long, ids array<int>")
    got = dict(rows(sentence_pieces.decode(df, content), "i", "text"))
    assert got.pop(-1) == ""
    assert [got[i] for i in range(len(lists))] == [library.decode(x) for x in lists]


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KNOWN", 5)
    known = sentence_pieces.Chunks(sentence_pieces.Model(sentence_pieces.read_model()))
    library = sentencepiece.SentencePieceProcessor(model_proto=sentence_pieces.read_model())
    for i in range(5):
        text = f"some words {i} more words and {'w' * 40}{i}"
        assert sentence_pieces._encode_batch(known, [text.encode()], False)[0].tolist() == library.encode(text)
        assert len(known) < 20


# --- collocations

def mined(docs, least, top):
    counts, sizes = defaultdict(Counter), Counter()
    for _, lang, _, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out, key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases(n=150):
    rng = random.Random(9)
    words = ["New", "york", "city", "hall", "a", "b", "c", "é", "Über", "x\x00y", "日本"]
    docs = []
    for i in range(n):
        parts = [rng.choice(["new York city hall", "new york", rng.choice(words)]) + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", " ? "])
                 for _ in range(rng.randint(0, 25))]
        docs.append((i, rng.choice(["en", "en", "fr", None]), "s", "".join(parts)))
    return docs + [(None, "en", "s", None), (1, "", "s", ""), (2, "de", "s", " .,"), (3, "la", "s", "ab " * 9000), (4, "la", "s", "ab ab,ab"), (4, "la", "s", "ab ab,ab")]


@pytest.mark.parametrize("size, bucket", [(3 << 20, 1 << 21), (5000, 4000)])
def test_collocations(spark, monkeypatch, size, bucket):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
    monkeypatch.setattr(collocations, "HELD_BYTES", 4 * size)
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    docs = phrases()
    df = awkward(spark, docs, 3, GROUPED).withColumn("a", F.lit("not a")).withColumn("block", F.lit("not block"))
    for least, top in ((30, 2000), (5, 4)):
        assert rows(collocations.collocations(df, least, top), *COLUMNS) == mined(docs, least, top)
    assert collocations.collocations(empty(spark, GROUPED)).collect() == []


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With fingerprints of 6 bits nearly all collide; the text decides."""
    docs = phrases(60)

    def coarse(self, firsts):
        begin = np.concatenate([self.begins[first] for _, first in firsts])
        end = np.concatenate([self.ends[first + n - 1] for n, first in firsts])
        short = collocations.hash_runs(self.raw, begin, end) & np.uint64(0x8000000000000017)
        return np.split(short, np.cumsum([len(first) for _, first in firsts])[:-1])

    def run(tables):
        """The three steps on one block per language, without Spark."""
        out = []
        for lang, texts in tables.items():
            batch = pa.record_batch({"lang": pa.array([lang] * len(texts)), "text": pa.array(texts, pa.string())})
            for b in collocations._blocks(iter([batch])):
                blocks = pa.Table.from_batches([b]).append_column("block", pa.array([0]))
                short = pa.Table.from_batches(list(collocations._short_prints(1)(iter(blocks.to_batches()))))
                short = collocations._frequent(5)(short)
                long = collocations._frequent(5)(collocations._long_prints(1)(blocks, short))
                found = collocations._spelled(1)(blocks, pa.concat_tables([short, long]))
                out += [(r["lang"], r["phrase"], r["a"]) for r in collocations._added(5)(found).to_pylist()]
        return sorted(out)

    tables = defaultdict(list)
    for _, lang, _, text in docs:
        tables[lang or "und"].append(text)
    expected = run(tables)
    monkeypatch.setattr(collocations.Block, "prints", coarse)
    assert run(tables) == expected and len(expected) > 50


def test_normalised_text():
    raw, starts = flat(pa.array([" A,b  c\t!d\n", None, "", "..", "é x"]))
    out, ends = collocations.normalised(raw, starts)
    assert out.tobytes().decode() == "a\nb c\nd\né x\n"
    assert ends.tolist() == [8, 8, 8, 8, 13]
