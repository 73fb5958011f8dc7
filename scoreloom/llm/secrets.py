"""Secrets: fixed patterns, and a battery of randomness tests for the rest.

The base patterns (assignments of passwords and keys, access keys, long hex
strings) always stay. The method adds other strings that look random:
a maximal run of key characters, be they letters, digits or signs, is given an
encoding (hex, letters of one or two cases, base 32, base 36, base 62, base
64), and three tests ask whether its characters are drawn evenly and
independently: chi-squared on the alphabet, runs above and below the middle,
serial correlation of neighbours. Fisher's method joins the three.

How random ordinary text looks depends on length and spelling (one case, two
cases, signs), which make the classes. Ordinary words that follow each other,
run together to every length, are the null distribution from which a
candidate's p-value is read: all such words of every whole document, so that it
grows with the candidates, and in a class with fewer than ``DRAWS`` strings as
many more from a fixed list of words, so that the null is usable in a corpus of
any size and with words of any length. Benjamini-Hochberg at ``RATE`` per class
then bounds the share of false discoveries. Both distributions are histograms
of fixed size.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scoreloom.llm.runtime import stored
from scoreloom.llm.textvec import flat, lowered, portions, words_of

KINDS = ("assign", "access", "hex")
ADDED = "random"
# The base patterns. ASCII case folding only.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}
RANDOM_LEAST = 20
LENGTHS = (20, 24, 32, 48, 64, 128)         # lower ends of the length classes
BINS = 64
RATE = 0.01
DRAWS = 5_000               # least strings of ordinary words a class is held against
GATHERED = 2_048            # ordinary strings tested at a time
SPELLINGS = 3               # one case, two cases, signs
WORD_LETTERS = (2, 19)      # letters of an ordinary word
ORDINARY = """time year people way day man thing woman life child world school state family student group country problem hand part
place case week company system program question work government number night point home water room mother area money story fact
month lot right study book eye job word business issue side kind head house service friend father power hour game line end member
law car city community name president team minute idea kid body information back parent face others level office door health person
art war history party result change morning reason research girl guy moment air teacher force education about after again because
before between could different every first found great however important include index button image content document request
response message server client user default value field table column title header footer section article page module function
return error internal configuration application development management description international version update create delete
select insert value parse handler factory service controller manager provider element attribute property quick jump wizard
oxygen zero xml query json http www html key max fix box view follow very give with would which what were when where""".split()
_HEX = np.zeros(256, dtype=bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_KEY = np.zeros(256, dtype=bool)
_KEY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-="]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _order(alphabet: str) -> np.ndarray:
    out = np.full(256, -1, dtype=np.int64)
    for i, c in enumerate(alphabet):
        out[ord(c)] = i
    return out


_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# From small to large; a string has the first that holds all its characters.
ENCODINGS = tuple((name, len(a), _order(a)) for name, a in (
    ("hex", _DIG + "abcdef"), ("HEX", _DIG + "ABCDEF"), ("lower", _LOW), ("UPPER", _UP), ("base32", _UP + "234567"),
    ("base36", _DIG + _LOW), ("BASE36", _DIG + _UP), ("letters", _UP + _LOW), ("base62", _UP + _LOW + _DIG)))
_BASE64 = _order(_UP + _LOW + _DIG + "+/")
_BASE64[[ord("-"), ord("_")]] = 62, 63


def _tail(z: float) -> float:
    """Upper tail of the normal distribution."""
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def randomness(text: bytes) -> float:
    """Joint p-value of the three tests: near 0 for ordinary text."""
    raw = np.frombuffer(text.rstrip(b"="), dtype=np.uint8)
    for _, size, order in ENCODINGS:
        values = order[raw]
        if values.min(initial=0) >= 0:
            break
    else:
        size, values = 64, _BASE64[raw]
        values = values[values >= 0]
    n = len(values)
    if n < 8:
        return 1e-300
    counts = np.bincount(values, minlength=size)
    chi = float((counts.astype(float) ** 2).sum()) * size / n - n
    even = _tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = values >= size / 2
    ones = int(high.sum())
    zeros = n - ones
    if ones and zeros:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * ones * zeros / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        steady = min(1.0, 2 * _tail(abs(runs - mean) / spread))
    else:
        steady = 0.5 ** (n - 1)
    centred = values - values.mean()
    power = float(centred @ centred)
    serial = min(1.0, 2 * _tail(abs(float(centred[1:] @ centred[:-1])) / power * math.sqrt(n))) if power else 1e-300
    joint = -(math.log(max(even, 1e-300)) + math.log(max(steady, 1e-300)) + math.log(max(serial, 1e-300)))
    # Chi-squared with six degrees of freedom, upper tail of twice the sum.
    return max(math.exp(-joint) * (1 + joint + joint * joint / 2), 1e-300) if joint < 600 else 1e-300


_ORDERS = np.stack([*(order for _, _, order in ENCODINGS), _BASE64])
_SIZES = np.array([*(size for _, size, _ in ENCODINGS), 64])
# Per byte, a bit for every encoding that holds it; base 64 takes the rest.
_HOLDS = ((_ORDERS >= 0) << np.arange(len(_ORDERS))[:, None]).sum(axis=0)
_HOLDS |= 1 << len(ENCODINGS)


def _tails(z: np.ndarray) -> np.ndarray:
    return np.array([_tail(x) for x in z.tolist()])


def randomness_of(texts: list[bytes]) -> np.ndarray:
    """``randomness`` of many strings of eight or more characters, all of them of base 64, at once."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = np.array([len(t) for t in texts])
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    held = np.bitwise_and.reduceat(_HOLDS[raw], start)
    coded = np.log2(held & -held).astype(np.int64)
    size = _SIZES[coded]
    values = _ORDERS[coded[owner], raw]
    counts = np.bincount(owner * 64 + values, minlength=64 * len(n)).reshape(len(n), 64).astype(float)
    chi = (counts ** 2).sum(axis=1) * size / n - n
    even = _tails((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n))
    high = values >= size[owner] / 2
    ones = np.add.reduceat(high, start, dtype=np.int64)
    zeros = n - ones
    inner = owner[1:] == owner[:-1]
    runs = 1 + np.bincount(owner[1:][inner & (high[1:] != high[:-1])], minlength=len(n))
    mean = 1 + 2 * ones * zeros / n
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    steady = np.where((ones > 0) & (zeros > 0), np.minimum(1.0, 2 * _tails(np.abs(runs - mean) / spread)), 0.5 ** (n - 1))
    centred = values - (np.add.reduceat(values, start) / n)[owner]
    power = np.add.reduceat(centred * centred, start)
    moved = np.bincount(owner[1:][inner], weights=(centred[1:] * centred[:-1])[inner], minlength=len(n))
    serial = np.where(power > 0, np.minimum(1.0, 2 * _tails(np.abs(moved) / np.where(power > 0, power, 1) * np.sqrt(n))), 1e-300)
    joint = -sum(np.log(np.maximum(x, 1e-300)) for x in (even, steady, serial))
    return np.where(joint < 600, np.maximum(np.exp(-np.minimum(joint, 600)) * (1 + joint + joint * joint / 2), 1e-300), 1e-300)


def result_bin(p: float) -> int:
    """0 for the most random results, rising as the p-value falls."""
    return min(BINS - 1, int(-4 * math.log10(p)))


CLASSES = SPELLINGS * len(LENGTHS)


def _class(text: bytes) -> int:
    """The class of a string, from its length and spelling."""
    if not text.rstrip(b"=").isalnum():
        spelling = 2
    else:
        spelling = int(text.lower() != text and text.upper() != text)
    return spelling * len(LENGTHS) + sum(len(text) >= low for low in LENGTHS) - 1


def _run_together(words: list[bytes], length: int, spelling: int, numbered: bool) -> bytes:
    """The first ``length`` bytes of words as identifiers and paths spell them."""
    if spelling == 0:
        text = b"".join(words).lower()
    elif spelling == 1:
        text = b"".join(w.capitalize() for w in words)
    else:
        text = b"_-/"[length % 3:length % 3 + 1].join(words)
    number = b"%d" % (7 * length % 130) if numbered else b""
    return text[:length - len(number)] + number


def _upper(length: int) -> int:
    return LENGTHS[length + 1] if length + 1 < len(LENGTHS) else 2 * LENGTHS[length]


def _ordinary(data: bytes, begin: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
    """Strings of every length in turn, until the words data[begin:end], in order, suffice for none."""
    seed, ends = len(begin), np.cumsum(np.concatenate(([0], end - begin))).tolist()
    at = turn = 0
    while True:
        lap, i = divmod(turn, len(LENGTHS))
        length = LENGTHS[i] + (seed * 7919 + turn) % (_upper(i) - LENGTHS[i])
        while ends[at] + length > ends[-1] and i:
            # The rest of the words goes to a shorter string.
            i -= 1
            length = LENGTHS[i] + (seed * 7919 + turn) % (_upper(i) - LENGTHS[i])
        if ends[at] + length > ends[-1]:
            return
        to = bisect.bisect_left(ends, ends[at] + length, at)
        words = [data[a:b] for a, b in zip(begin[at:to].tolist(), end[at:to].tolist())]
        yield _run_together(words, length, (seed + turn + lap) % SPELLINGS, (seed // SPELLINGS + lap) % 2 > 0)
        at, turn = to, turn + 1


def _binned(texts: Iterator[bytes]) -> list[int]:
    """Class and bin of every string, some strings at a time."""
    out = []
    while some := list(itertools.islice(texts, GATHERED)):
        out += [_class(t) * BINS + result_bin(p) for t, p in zip(some, randomness_of(some).tolist())]
    return out


@functools.cache
def _listed(cls: int) -> tuple[int, ...]:
    """How many of ``DRAWS`` strings of the fixed list have each bin, in a class."""
    rng = np.random.default_rng(cls)
    spelling, i = divmod(cls, len(LENGTHS))
    high = _upper(i)
    words = [w.encode() for w in ORDINARY]
    counts = [0] * BINS
    for k, (size, picks) in enumerate(zip(rng.integers(LENGTHS[i], high, DRAWS), rng.integers(0, len(words), (DRAWS, high // 2)))):
        counts[result_bin(randomness(_run_together([words[w] for w in picks], int(size), spelling, k % 2 > 0)))] += 1
    return tuple(counts)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cls", pa.int32()), ("bin", pa.int32())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("candidates", pa.list_(_CANDIDATE)), ("ordinary", pa.list_(pa.int32()))])
_FIELDS = ("doc_id long, base array<struct<kind: string, start: long, end: long>>, "
           "candidates array<struct<start: long, end: long, cls: int, bin: int>>, ordinary array<int>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        raw, starts = flat(batch.column("text"))
        base = [[] for _ in range(batch.num_rows)]
        found = [[] for _ in range(batch.num_rows)]
        # Offsets in code points: bytes that do not continue a character.
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        data, low = raw.tobytes(), lowered(raw).tobytes()

        def at(byte, text):
            return int(points[byte] - points[starts[text]])

        for kind, hints, body in (("assign", HINTS, low), ("access", (b"AKIA",), data)):
            hit = set()
            for hint in hints:
                place = body.find(hint)
                while place >= 0:
                    text = int(np.searchsorted(starts, place, side="right")) - 1
                    hit.add(text)
                    place = body.find(hint, int(starts[text + 1]))
            for text in hit:
                whole = data[starts[text]:starts[text + 1]].decode("utf-8", "replace")
                for m in (ASSIGN if kind == "assign" else ACCESS).finditer(whole):
                    if len(m[m.lastindex or 0]) >= LEAST[kind]:
                        base[text].append((kind, m.start(), m.end()))
        begin, end, text = words_of(raw, starts, _HEX)
        for i in np.flatnonzero(end - begin >= LEAST["hex"]):
            base[text[i]].append(("hex", at(begin[i], text[i]), at(end[i], text[i])))

        begin, end, text = words_of(raw, starts, _KEY)
        for i in np.flatnonzero(end - begin >= RANDOM_LEAST):
            a, b, t = int(begin[i]), int(end[i]), int(text[i])
            found[t].append({"start": at(a, t), "end": at(b, t), "cls": _class(data[a:b]), "bin": result_bin(randomness(data[a:b]))})
        # Whole runs of letters only: pieces of a key are no ordinary words.
        letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
        usual = (end - begin >= WORD_LETTERS[0]) & (end - begin <= WORD_LETTERS[1]) & (letters[end] - letters[begin] == end - begin)
        begin, end, text = begin[usual], end[usual], text[usual]
        first = np.searchsorted(text, np.arange(batch.num_rows + 1))
        made = [0]

        def strings():
            for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
                m = 0
                for m, one in enumerate(_ordinary(data, begin[x:y], end[x:y]), 1):
                    yield one
                made.append(made[-1] + m)

        ordinary = pa.array(_binned(strings()), pa.int32())
        for spans in base:
            spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in base], pa.list_(_SPAN)),
            pa.array(found, pa.list_(_CANDIDATE)), pa.ListArray.from_arrays(pa.array(made, pa.int32()), ordinary)], schema=_SCHEMA)


def discoveries(counts: list[tuple[int, int, bool, int]], rate: float = RATE) -> dict[int, int]:
    """Last accepted bin of every class, by Benjamini-Hochberg.

    ``counts`` are (class, bin, plain, n). The p-value of a bin is the
    share of ordinary (plain) strings of the class that look at least as random.
    Classes with fewer than ``DRAWS`` ordinary strings take those of the fixed list too.
    """
    out = {}
    for own in range(CLASSES):
        null, tested = [0] * BINS, [0] * BINS
        for cls, place, plain, n in counts:
            if cls == own:
                (null if plain else tested)[place] += n
        m = sum(tested)
        if m and sum(null) < DRAWS:
            null = [x + y for x, y in zip(null, _listed(own))]
        total = sum(null)
        below = ahead = 0
        for place in range(BINS):
            below += null[place]
            ahead += tested[place]
            if ahead and (1 + below) / (1 + total) <= rate * ahead / m:
                out[own] = place
    return out


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base and spans of every document: arrays of (kind, start, end)
    in code points, end exclusive, by start, then kind (base kinds as listed,
    added ones last). ``spans`` holds the base spans and the added ones, which
    never overlap a base span.

    NULL and empty texts have no spans. Repeated rows and NULL ids are kept as
    they are, an empty table gives no rows, further columns are ignored.
    Matching is linear in the text.
    """
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_scan, _FIELDS))
    rows = stored(rows, "secrets")
    counts = (rows.select(F.explode("candidates").alias("c")).groupBy("c.cls", "c.bin", F.lit(False).alias("plain")).agg(F.count(F.lit(1)).alias("n"))
              .unionByName(rows.select(F.explode("ordinary").alias("o")).groupBy(
                  F.floor(F.col("o") / BINS).cast("int").alias("cls"), (F.col("o") % BINS).alias("bin"), F.lit(True).alias("plain"))
                  .agg(F.count(F.lit(1)).alias("n"))).collect())
    last = discoveries([tuple(r) for r in counts], rate)
    limits = F.array(*[F.lit(last.get(i, -1)) for i in range(CLASSES)])
    free = F.filter("candidates", lambda c: (c["bin"] <= F.element_at(limits, c["cls"] + 1))
                    & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.transform(free, lambda c: F.struct(F.lit(ADDED).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", "base", by_start(F.concat(F.col("base"), added)).alias("spans"))


def by_start(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    ranked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def spelled(spans) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
