"""Phrase collocations by Rabin-Karp fingerprints.

Texts of one language are normalised into blocks: lower-cased words, each
followed by one blank, or by a line end where a piece ends. A prefix polynomial
over the bytes of a block gives the fingerprint of every phrase of one to four
words by one subtraction. A block sends its distinct fingerprints with their
counts; the occurrence pointer that travels along is the number of the block.

Where the counts of a fingerprint add up to the least count, its pointers are
followed back: every block they name looks up its own occurrences, compares
them word by word with the text of the first (equal fingerprints of different
phrases part here) and sends the phrase itself with its exact count. So only
frequent phrases are ever spelled out.

Phrases of three and four words are fingerprinted in a second round, and only
where all their pairs of words are frequent. Blocks and fingerprints move in
proportion to the input; no list or filter of phrases is broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from scoreloom.llm.runtime import parts_for, stored
from scoreloom.llm.textvec import U64, flat, hash_runs, lowered, mix, portions, words_of

WORDS = 4                   # of the longest phrase
LEAST = 30
TOP = 2000
SCALE = 2_000_000
COVER = (80, 100)           # a longer phrase this frequent takes the place of its parts
BLOCK_BYTES = 3 << 20       # normalised text of a block, unless one text is longer
HELD_BYTES = 12 << 20       # text held for all languages of a task
BUCKET = 1 << 21            # fingerprints reduced by a task, about
# Fixed values of the rule: what parts words, and what parts pieces.
_BLANK, _CUT = b"\x20\x09", b".,;:!?\x0A\x0B\x0C\x0D"
_GAP, _END = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_GAP[list(_BLANK + _CUT)] = True
_END[list(_CUT)] = True
SPACE, LINE = 32, 10


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    planes = pa.decompress(blob[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(dtype).reshape(n)


# --- blocks

def normalised(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts in one buffer, each followed by a blank or, where a
    piece or text ends, a line end; and where every text ends in it."""
    raw = lowered(raw)
    begin, end, owner = words_of(raw, starts, ~_GAP)
    if not len(begin):
        return np.zeros(0, np.uint8), np.zeros(len(starts) - 1, np.int64)
    cuts = np.concatenate(([0], np.cumsum(_END[raw])))
    closes = np.append((cuts[begin[1:]] > cuts[end[:-1]]) | (owner[1:] != owner[:-1]), True)
    size = end - begin + 1
    to = np.cumsum(size)
    out = raw[np.minimum(np.repeat(begin - (to - size), size) + np.arange(to[-1]), len(raw) - 1)]
    out[to - 1] = np.where(closes, LINE, SPACE)
    last = np.cumsum(np.bincount(owner, minlength=len(starts) - 1))
    return out, np.concatenate(([0], to))[last]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def sent(lang):
        text = b"".join(held.pop(lang))
        sizes.pop(lang)
        words = int(np.isin(np.frombuffer(text, np.uint8), (SPACE, LINE)).sum())
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([words], pa.int64()), pa.array([len(text)], pa.int64()),
                                           pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())], names=["lang", "words", "size", "text"])

    for batch in portions(batches):
        langs = batch.column("lang").to_pylist()
        out, ends = normalised(*flat(batch.column("text")))
        data, at = out.tobytes(), 0
        for lang, to in zip(langs, ends.tolist()):
            if to > at:
                held[lang].append(data[at:to])
                sizes[lang] += to - at
            at = to
        for lang in [x for x, size in sizes.items() if size > BLOCK_BYTES]:
            yield sent(lang)
        while sum(sizes.values()) > HELD_BYTES:
            yield sent(max(sizes, key=sizes.get))
    for lang in list(held):
        yield sent(lang)


class Block:
    """The words of a block and the fingerprints of its phrases."""

    def __init__(self, lang: str, size: int, text: bytes):
        self.raw = np.frombuffer(pa.decompress(text, size, "zstd", asbytes=True), np.uint8)
        self.ends = np.flatnonzero((self.raw == SPACE) | (self.raw == LINE))
        self.begins = np.concatenate(([0], self.ends[:-1] + 1))
        self.piece = np.concatenate(([0], np.cumsum(self.raw[self.ends] == LINE)[:-1]))
        name = np.frombuffer(lang.encode() or b"\x00", np.uint8)
        self.seed = hash_runs(name, np.array([0]), np.array([len(name)]))[0]

    def phrases(self, n: int) -> np.ndarray:
        """First words of all phrases of ``n`` words."""
        last = len(self.ends) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1:]) if last > 0 else np.zeros(0, np.int64)

    def prints(self, firsts: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """Fingerprints of phrases given by length and first words."""
        begin = np.concatenate([self.begins[first] for _, first in firsts])
        end = np.concatenate([self.ends[first + n - 1] for n, first in firsts])
        all_of = mix(hash_runs(self.raw, begin, end) ^ self.seed)
        return np.split(all_of, np.cumsum([len(first) for _, first in firsts])[:-1])


_SENT = "bucket int, block long, prints binary, counts binary"


def _bucket(prints: np.ndarray, buckets: int) -> np.ndarray:
    return ((prints >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _dealt(block: int, prints: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Distinct fingerprints of a block with their counts, by bucket."""
    prints, counts = np.unique(prints, return_counts=True)
    bucket = _bucket(prints, buckets)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    slices = [slice(cuts[b], cuts[b + 1]) for b in full.tolist()]
    return pa.RecordBatch.from_arrays([
        pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()),
        pa.array([packed(prints[s]) for s in slices], pa.binary()),
        pa.array([packed(counts[s].astype(np.uint32)) for s in slices], pa.binary())], names=["bucket", "block", "prints", "counts"])


def _short_prints(buckets: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["lang"], row["size"], row["text"])
                yield _dealt(row["block"], np.concatenate(block.prints([(n, block.phrases(n)) for n in (1, 2)])), buckets)

    return prints


def _frequent(least: int):
    def frequent(table: pa.Table) -> pa.Table:
        """Fingerprints of a bucket whose counts reach ``least``, given back to
        the blocks that hold them."""
        blocks = table.column("block").to_numpy()
        lists = [unpacked(b, np.uint64) for b in table.column("prints").to_pylist()]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        prints = np.concatenate(lists)
        counts = np.concatenate([unpacked(b, np.uint32) for b in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(prints, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(prints[order]) != 0)))
        enough = np.add.reduceat(counts[order], heads) >= least
        chosen = np.zeros(len(prints), dtype=bool)
        chosen[order] = np.repeat(enough, np.diff(np.append(heads, len(prints))))
        kept, owner = prints[chosen], owner[chosen]
        cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
        some = np.flatnonzero(np.diff(cuts))
        return pa.table({"block": pa.array(blocks[some], pa.int64()),
                         "prints": pa.array([packed(kept[cuts[i]:cuts[i + 1]]) for i in some.tolist()], pa.binary())})

    return frequent


def _pointed(right: pa.Table) -> np.ndarray:
    """All fingerprints that point to a block, in order."""
    lists = [unpacked(b, np.uint64) for b in right.column("prints").to_pylist()]
    return np.sort(np.concatenate(lists)) if lists else np.zeros(0, U64)


def _among(prints: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(prints), dtype=bool)
    return known[np.minimum(np.searchsorted(known, prints), len(known) - 1)] == prints


def _rows(left: pa.Table) -> Iterator[Block]:
    for row in left.to_pylist():
        yield row["block"], Block(row["lang"], row["size"], row["text"])


def _long_prints(buckets: int):
    def prints(left: pa.Table, right: pa.Table) -> pa.Table:
        """Longer phrases of a block all of whose pairs of words are frequent."""
        known, out = _pointed(right), []
        for number, block in _rows(left):
            pairs = block.phrases(2)
            ok = np.zeros(len(block.ends) + WORDS, dtype=bool)
            ok[pairs[_among(block.prints([(2, pairs)])[0], known)]] = True
            firsts = []
            for n in range(3, WORDS + 1):
                first = block.phrases(n)
                for k in range(n - 1):
                    first = first[ok[first + k]]
                firsts.append((n, first))
            out.append(_dealt(number, np.concatenate(block.prints(firsts)), buckets))
        return pa.Table.from_batches(out)

    return prints


def word_numbers(block: Block) -> np.ndarray:
    """A number for every word, equal for equal bytes only: words of one
    fingerprint are compared with the first of them."""
    prints = block.prints([(1, np.arange(len(block.ends)))])[0]
    _, first, number = np.unique(prints, return_index=True, return_inverse=True)
    size = block.ends - block.begins
    differs = size != size[first][number]
    step = 1 << 17
    for at in range(0, len(size), step):
        some = np.arange(at, min(at + step, len(size)))
        some = some[~differs[some]]
        lengths = size[some]
        shift = np.repeat(np.cumsum(lengths) - lengths, lengths)
        inside = np.arange(len(shift)) - shift
        same = (block.raw[np.repeat(block.begins[some], lengths) + inside]
                == block.raw[np.repeat(block.begins[first[number[some]]], lengths) + inside])
        differs[some[np.unique(np.repeat(np.arange(len(some)), lengths)[~same])]] = True
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(differs).tolist():
        word = block.raw[block.begins[i]:block.ends[i]].tobytes()
        number[i] = others.setdefault(word, len(first) + len(others))
    return number


_SPELLED = "bucket int, lang string, size long, phrases binary, words binary, counts binary"


def _spelled(buckets: int):
    def spelled(left: pa.Table, right: pa.Table) -> pa.Table:
        """Phrases of a block that its pointers name, with their counts, packed by bucket."""
        known, rows = _pointed(right), []
        for lang, (_, block) in zip(left.column("lang").to_pylist(), _rows(left)):
            numbers = word_numbers(block)
            found: list[dict] = [defaultdict(int) for _ in range(buckets)]
            firsts = [(n, block.phrases(n)) for n in range(1, WORDS + 1)]
            for (n, first), prints in zip(firsts, block.prints(firsts)):
                hit = _among(prints, known)
                first, prints = first[hit], prints[hit]
                if not len(first):
                    continue
                prints, lead, group = np.unique(prints, return_index=True, return_inverse=True)
                same = np.ones(len(first), dtype=bool)
                for k in range(n):
                    same &= numbers[first + k] == numbers[first[lead][group] + k]
                counts = np.bincount(group, same, len(lead)).astype(np.int64)
                data, to = block.raw, _bucket(prints, buckets)
                begins, ends = block.begins[first[lead]], block.ends[first[lead] + n - 1]
                for bucket, a, b, count in zip(to.tolist(), begins.tolist(), ends.tolist(), counts.tolist()):
                    found[bucket][n, data[a:b].tobytes()] += count
                for i in np.flatnonzero(~same).tolist():
                    a, b = block.begins[first[i]], block.ends[first[i] + n - 1]
                    found[to[group[i]]][n, data[a:b].tobytes()] += 1
            for bucket, phrases in enumerate(found):
                if phrases:
                    text = b"\n".join(phrase for _, phrase in phrases)
                    rows.append((bucket, lang, len(text), pa.compress(text, "zstd", asbytes=True),
                                 packed(np.array([n for n, _ in phrases], dtype=np.uint8)), packed(np.array([*phrases.values()], dtype=np.int64))))
        columns = [*zip(*rows)] or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                        names=["bucket", "lang", "size", "phrases", "words", "counts"])

    return spelled


def _added(least: int):
    def added(table: pa.Table) -> pa.Table:
        """Exact counts of the phrases of a bucket that reach ``least``."""
        parts = []
        for row in table.to_pylist():
            phrases = pa.decompress(row["phrases"], row["size"], "zstd", asbytes=True).split(b"\n")
            parts.append(pa.table({"lang": pa.array([row["lang"]] * len(phrases), pa.string()), "k": pa.array(unpacked(row["words"], np.uint8)).cast(pa.int32()),
                                   "phrase": pa.array(phrases, pa.binary()), "a": pa.array(unpacked(row["counts"], np.int64))}))
        whole = pa.concat_tables(parts).group_by(["lang", "k", "phrase"]).aggregate([("a", "sum")])
        whole = whole.filter(pc.greater_equal(whole.column("a_sum"), least))
        return pa.table({"lang": whole.column("lang"), "k": whole.column("k"), "phrase": whole.column("phrase").cast(pa.string()), "a": whole.column("a_sum")})

    return added


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, k words, phrase, a) that occur ``least`` times, and the
    number of words per language (lang, n). Both are stored."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = stored(texts.mapInArrow(_blocks, "lang string, words long, size long, text binary")
                    .withColumn("block", F.monotonically_increasing_id()), "blocks")
    sizes = stored(blocks.groupBy("lang").agg(F.sum("words").alias("n")), "sizes")
    words = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(2 * words, BUCKET)

    def reduced(sent):
        return sent.groupBy("bucket").applyInArrow(_frequent(least), "block long, prints binary")

    short = stored(reduced(blocks.mapInArrow(_short_prints(buckets), _SENT)), "short-phrases")
    long = stored(reduced(blocks.groupBy("block").cogroup(short.groupBy("block")).applyInArrow(_long_prints(buckets), _SENT)), "long-phrases")
    every = short.unionByName(long)
    spelled = blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_spelled(buckets), _SPELLED)
    phrases = spelled.groupBy("bucket").applyInArrow(_added(least), "lang string, k int, phrase string, a long")
    return stored(phrases, "phrases"), sizes


def _part(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(phrases: DataFrame, least_words: int = 2) -> DataFrame:
    """lang, phrase, k, a, l, r, score of every phrase of two or more words, by
    its worst cut."""
    candidates = phrases.where(F.col("k") >= least_words).withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "k", "a", "at", _part(F.col("w"), 1, F.col("at")).alias("ahead"),
                       _part(F.col("w"), F.col("at") + 1, F.col("k")).alias("behind"))
    known = phrases.select("lang", "phrase", "a")
    for name, side in (("l", "ahead"), ("r", "behind")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    worst = F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("worst")
    return (cuts.groupBy("lang", "phrase", "k", "a").agg(worst)
            .select("lang", "phrase", "k", "a", "worst.l", "worst.r", "worst.score"))


def covered(phrases: DataFrame) -> DataFrame:
    """lang, phrase, most: the highest count of a longer phrase around it."""
    w = F.split("phrase", " ")
    longer = phrases.where(F.col("k") >= 3)
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _part(w, i, m))))
    return (longer.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language.

    NULL and empty texts have no words; a NULL language is ``und``; every row
    counts, repeated ones too; ties go to the higher count and then to the
    phrase that is earlier in UTF-8. A language without frequent phrases, and
    an empty table, give no rows. Further columns are ignored. A text longer
    than a block is a block of its own.
    """
    phrases, sizes = frequent_phrases(docs, least)
    rows = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left")
    left = rows.where(F.col("most").isNull() | (COVER[1] * F.col("most") < COVER[0] * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
