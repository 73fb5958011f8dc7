"""Near-duplicate join: a blocked sparse product of document by n-gram incidence.

Documents are sets of word shingles. Two link when the overlap is at least 0.8
of the union, hence at least 0.8 of the larger set; so two linked sets share an
n-gram among the rarest fifth of each. Only these columns of the incidence
matrix are multiplied: they are dealt to blocks by n-gram, and inside a block
every column yields the pairs of its documents. Most columns have one document;
the entries of the others are joined with a sketch of their set before they are
multiplied, so that unlike sets yield no pair. Pairs are discarded by bounds:
the ratio of sizes, the least difference that two sketches show, the number of
columns that a linked pair of these sizes shares at least, then an upper bound
of the overlap from bit maps of the sets. For the few left, overlaps are counted
exactly.

Equal sets are one row throughout. The order "rarest first" needs frequent
n-grams only (any order gives the same links): each map task reports n-grams
that are frequent among its documents, and the most frequent are broadcast.

A column longer than ``LONG`` is not multiplied out at once. Its documents are
first compared with a few pivots, which gathers groups of near copies into
components. Then only pairs from different components remain; they are
multiplied block by block on bit maps, so that a large group of documents that
resemble each other without linking leaves hardly any pair to be moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoreloom.llm.components import components
from scoreloom.llm.runtime import once, parts_for, stored, text_bytes, text_tag
from scoreloom.llm.suffix_dedup import joined, pack, taken, unpack
from scoreloom.llm.textvec import NOT_SPACE, ODD, U64, flat, hash_runs, lowered, mix, portions, shingle_hashes, words_of

WIDTH = 5
SHARE = (80, 100)           # links when SHARE[1] * overlap >= SHARE[0] * union
FREQUENT = 50_000           # n-grams ordered by count, all others by hash
GATHER_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
LONG = 128                  # documents of a column that are multiplied out
HOT_LOCAL = 64              # documents of a column in one gathering beyond which it is salted
SALTS = 32
BLOCK = 2048                # documents of a long column multiplied at a time
SHARED = 8                  # columns that a pair is asked to share, if its sizes demand as many
DENSE = 32                  # sets of a block that share an n-gram beyond which it is counted by matrix
SKETCH = 4, 16              # 64-bit words in the sketch of a small and of a large set
LARGE = 500                 # n-grams from which a set is large
FILTER_WORDS = 1 << 18      # most 64-bit words of the broadcast filter


def _sets(batch: pa.RecordBatch, width: int):
    """Distinct shingle hashes of every text, sorted by (text, hash)."""
    raw, starts = flat(batch.column("text"))
    low = lowered(raw)
    begin, end, owner = words_of(low, starts, NOT_SPACE)
    h, of = shingle_hashes(hash_runs(low, begin, end), owner, batch.num_rows, width)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], of[new]


def _names(h: np.ndarray, of: np.ndarray, n_texts: int):
    """A 64-bit name of every set, from the sum of its scrambled members, and its size."""
    n = np.bincount(of, minlength=n_texts).astype(np.int64)
    total = np.concatenate(([U64(0)], np.cumsum(mix(h ^ U64(ODD[6])), dtype=U64)))
    ends = np.cumsum(n)
    return mix(total[ends] - total[ends - n] + n.astype(U64) * U64(ODD[2])).view(np.int64), n


def _least(n, share):
    """Least overlap of a set of size n with any set it links to."""
    return (share[0] * n + share[1] - 1) // share[1]


def _frequent(width: int):
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def flush():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= max(4, docs // 1000)
            return pa.RecordBatch.from_arrays([pa.array(grams[many].view(np.int64)), pa.array(n[many].astype(np.int64))], schema=schema)

        for batch in portions(batches):
            held.append(_sets(batch, width)[0])
            docs += batch.num_rows
            size += batch.column("text").nbytes
            if size >= GATHER_BYTES:
                yield flush()
                held, size, docs = [], 0, 0
        if held:
            yield flush()

    return count


def frequent_grams(docs: DataFrame, width: int, most: int = FREQUENT) -> np.ndarray:
    """The most frequent n-grams, rarer ones first; at most ``most``."""
    rows = (docs.mapInArrow(_frequent(width), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "gram").limit(most).toPandas())
    order = np.lexsort((rows["gram"], rows["n"]))
    return rows["gram"].to_numpy(dtype=np.int64)[order].view(U64)


def _bitmap(h: np.ndarray) -> bytes:
    """One bit per shingle in a power of two of at least eight bits per shingle."""
    bits = 64
    while bits < 8 * len(h):
        bits *= 2
    marks = np.zeros(bits, dtype=np.uint8)
    marks[(h >> U64(20)) % U64(bits)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def _sketches(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For every set and cell of hashes, whether an odd number of its shingles falls there.

    A cell in which two sets differ holds a shingle that only one of them has.
    """
    many = SKETCH[1]
    cell = (h >> U64(40)) % U64(64 * many)
    bit = U64(1) << cell % U64(64)
    out = np.zeros((len(n), many), dtype=U64)
    some = np.flatnonzero(n)
    for word in range(many if len(some) else 0):
        out[some, word] = np.bitwise_xor.reduceat(np.where(cell // U64(64) == word, bit, U64(0)), (np.cumsum(n) - n)[some])
    small = _narrow(out)
    return [(x if k >= LARGE else y).tobytes() for k, x, y in zip(n, out, small)]


def _narrow(sketches: np.ndarray) -> np.ndarray:
    """Sketches of large sets as those of small ones: cells are merged."""
    few, many = SKETCH
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), many // few, few), axis=1)


def _signer(width: int, share, frequent):
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("prefix", pa.binary()), ("bits", pa.binary()), ("sketch", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = frequent.value
        by_gram = np.argsort(listed)
        grams = listed[by_gram]
        for batch in portions(batches):
            h, of = _sets(batch, width)
            n = np.bincount(of, minlength=batch.num_rows)
            rank = np.zeros(len(h), dtype=np.int64)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
                rank = np.where(grams[at] == h, by_gram[at] + 1, 0)
            order = np.lexsort((h, rank, of))
            first = np.cumsum(n) - n
            place = np.arange(len(h)) - first[of]
            front = place < (n - _least(n, share) + 1)[of]
            rare, rare_of = h[order][front], of[front]
            kept = np.bincount(rare_of, minlength=batch.num_rows)
            ends = np.cumsum(kept)
            node, n = _names(h, of, batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("tag"), pa.array(n), pa.array(node),
                pa.array([rare[e - k:e].tobytes() for e, k in zip(ends, kept)], pa.binary()),
                pa.array([_bitmap(h[f:f + k]) for f, k in zip(first, n)], pa.binary()),
                pa.array(_sketches(h, n), pa.binary())], schema=schema)

    return sign


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.binary())])


def _table(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_BLOCKS)


def _dealer(parts: int):
    """Prefix n-grams of the sets, dealt to blocks by n-gram."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            rows = joined(held)
            # Equal sets of the gathering once.
            order = np.lexsort((rows["node"], rows["gram"]))
            rows = taken(rows, order)
            gram, node = rows["gram"], rows["node"]
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])))
            rows = taken(rows, new)
            gram = rows["gram"]
            start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            count = np.diff(np.concatenate((start, [len(gram)])))
            hot = np.repeat(count > HOT_LOCAL, count)
            part = (mix(gram) % U64(parts)).astype(np.int64)
            # A column met by many documents here is spread; one of them still goes home and stands for it.
            part[hot] = (mix(gram[hot] + mix(rows["node"][hot].view(U64)) % U64(SALTS)) % U64(parts)).astype(np.int64)
            rows["salted"] = hot.astype(np.uint8)
            first = start[count > HOT_LOCAL]
            if len(first):
                marks = taken(rows, first)
                marks["salted"] = np.full(len(first), 2, np.uint8)
                rows = joined([rows, marks])
                part = np.concatenate((part, (mix(gram[first]) % U64(parts)).astype(np.int64)))
            order = np.lexsort((rows["gram"], rows["node"], part))
            part = part[order]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:]):
                r = taken(rows, order[a:b])
                new = np.concatenate(([True], r["node"][1:] != r["node"][:-1]))
                yield int(part[a]), pack(nodes=r["node"][new], n=r["n"][new], many=np.diff(np.concatenate((np.flatnonzero(new), [len(new)]))).astype(np.uint32),
                                         gram=r["gram"], at=r["at"], salted=r["salted"])

        for batch in batches:
            k = np.asarray(pa.compute.binary_length(batch.column("prefix"))).astype(np.int64) // 8
            gram = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), dtype="<u8")
            held.append({"gram": gram.copy(), "node": np.repeat(batch.column("node").to_numpy(), k),
                         "n": np.repeat(batch.column("n").to_numpy(), k).astype(np.uint32),
                         "at": (np.arange(len(gram)) - np.repeat(np.cumsum(k) - k, k)).astype(np.uint32)})
            size += len(gram)
            if size >= 1 << 20:
                yield _table(flush())
                held, size = [], 0
        if size:
            yield _table(flush())

    return deal


def _columns(blocks: list[bytes]) -> dict[str, np.ndarray]:
    out = []
    for block in blocks:
        b = unpack(block)
        out.append({"gram": b["gram"], "node": np.repeat(b["nodes"], b["many"]), "n": np.repeat(b["n"], b["many"]), "at": b["at"], "salted": b["salted"]})
    return joined(out)


_ENTRIES = pa.schema([("part", pa.int32()), ("gram", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("salted", pa.bool_())])
_ENTRY_FIELDS = "part int, gram long, node long, n int, at int, salted boolean"


def _shared_columns(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Entries of the columns of one block that may have more than one set.

    A column that is spread is marked where any of its entries is.
    """
    rows = _columns(group.column("block").to_pylist())
    # Of equal sets, one that marks the column as spread comes first.
    rows = taken(rows, np.lexsort((-rows["salted"].astype(np.int8), rows["node"], rows["gram"])))
    gram, node = rows["gram"], rows["node"]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])))
    rows = taken(rows, new)
    gram = rows["gram"]
    start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    count = np.diff(np.concatenate((start, [len(gram)])))
    salted = np.maximum.reduceat(rows["salted"], start) > 0
    keep = np.repeat((count > 1) | salted, count)
    rows, salted = taken(rows, keep), np.repeat(salted, count)[keep]
    return pa.Table.from_arrays([pa.array(np.full(len(salted), key[0].as_py(), np.int32)), pa.array(rows["gram"].view(np.int64)), pa.array(rows["node"]),
                                 pa.array(rows["n"].astype(np.int32)), pa.array(rows["at"].astype(np.int32)), pa.array(salted)], schema=_ENTRIES)


_PAIRS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("times", pa.int64())])
PAIR, MEMBER = 0, 1
_PAIR_FIELDS = "kind int, a long, b long, na long, nb long, times long"


def _pairs(kind, a, b, na, nb, times=None) -> pa.Table:
    times = np.ones(len(a), np.int64) if times is None else times.astype(np.int64)
    return pa.Table.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(na.astype(np.int64)), pa.array(nb.astype(np.int64)), pa.array(times)], schema=_PAIRS)


def _multiplier(share):
    """Pairs of the columns of one block and how many they share, and the members of long columns.

    Pairs whose sketches rule a link out stay here. A pair has the same sketches
    in every block, so all columns it shares are counted or none.
    """
    def product(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("gram", "ascending"), ("n", "ascending"), ("node", "ascending")])
        gram, node, n, place = (group.column(c).to_numpy().astype(np.int64) for c in ("gram", "node", "n", "at"))
        start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        count = np.diff(np.concatenate((start, [len(gram)])))
        long = (count > LONG) | group.column("salted").to_numpy()[start]
        large = n >= LARGE
        sketch = group.column("sketch").filter(pa.array(large)).to_pylist()
        wide = np.frombuffer(b"".join(sketch), dtype=U64).reshape(len(sketch), SKETCH[1])
        row = np.cumsum(large) - 1
        narrow = np.empty((len(n), SKETCH[0]), dtype=U64)
        narrow[large] = _narrow(wide)
        narrow[~large] = np.frombuffer(b"".join(group.column("sketch").filter(pa.array(~large)).to_pylist()), dtype=U64).reshape(-1, SKETCH[0])
        out = []

        def differ(sketches, a, b):
            return sum(np.bitwise_count(word[a] ^ word[b]).astype(np.int64) for word in sketches.T)

        def alike(a, b):
            total = n[a] + n[b]
            most = total - 2 * ((share[0] * total + sum(share) - 1) // sum(share))
            good = np.flatnonzero(differ(narrow, a, b) <= most)
            more = large[a[good]] & large[b[good]]
            gone = good[more][differ(wide, row[a[good[more]]], row[b[good[more]]]) > most[good[more]]]
            return np.setdiff1d(good, gone, assume_unique=True)

        # Short columns: every pair whose sizes allow a link.
        column = np.repeat(np.arange(len(start)), count)
        short = np.flatnonzero(~long[column] & (count[column] > 1))
        if len(short):
            # Within a column sizes ascend: the partners of a row are the rows after it up to a size.
            reach = share[1] * n[short] // share[0]
            span = int(n.max()) * 2 + 2
            order_key = column[short] * span + n[short]
            stop = np.searchsorted(order_key, column[short] * span + reach, side="right")
            many = np.maximum(stop - np.arange(len(short)) - 1, 0)
            a = np.repeat(np.arange(len(short)), many)
            b = a + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            a, b = short[a], short[b]
            # Only columns early enough in both sets, see `_needed`.
            early = np.minimum(n[a] - place[a], n[b] - place[b]) > (share[0] * (n[a] + n[b]) + sum(share) - 1) // sum(share) - SHARED
            a, b = a[early], b[early]
            likely = alike(a, b)
            a, b = a[likely], b[likely]
            x, y = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            nx, ny = np.where(node[a] <= node[b], n[a], n[b]), np.where(node[a] <= node[b], n[b], n[a])
            order = np.lexsort((y, x))
            one = np.ones(len(order), dtype=bool)
            one[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
            times = np.diff(np.concatenate((np.flatnonzero(one), [len(one)])))
            order = order[one]
            out.append(_pairs(PAIR, x[order], y[order], nx[order], ny[order], times))
        # Long columns: each row with a pivot of its size band, and membership for later.
        for c in np.flatnonzero(long):
            rows_of = np.arange(start[c], start[c] + count[c])
            at = 0
            while at < len(rows_of):
                to = int(np.searchsorted(n[rows_of], share[1] * n[rows_of[at]] // share[0], side="right"))
                to = max(to, at + 1)
                band = rows_of[at:to]
                pivot = band[np.argmin(mix(node[band].view(U64)))]
                rest = band[band != pivot]
                rest = rest[alike(rest, np.full(len(rest), pivot))]
                x, y = np.minimum(node[rest], node[pivot]), np.maximum(node[rest], node[pivot])
                small = node[rest] <= node[pivot]
                out.append(_pairs(PAIR, x, y, np.where(small, n[rest], n[pivot]), np.where(small, n[pivot], n[rest])))
                at = to
            out.append(_pairs(MEMBER, np.full(count[c], gram[start[c]]), node[rows_of], n[rows_of], n[rows_of]))
        return pa.concat_tables(out) if out else pa.Table.from_batches([], schema=_PAIRS)

    return product


def _ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def _bounded(share):
    """Keep pairs whose bit maps allow enough overlap."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            least = (share[0] * (na + nb) + sum(share) - 1) // sum(share)
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                x, y = _folded(x, size), _folded(y, size)
                both = _ones(x & y)
                # Shingles that share a bit with another of their set may overlap unseen.
                good[i] = both + min(na[i] - _ones(x), nb[i] - _ones(y)) >= least[i]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])

    return keep


def _filter_words(ids: DataFrame, column: str, words: int) -> np.ndarray:
    """A filter of one bit per id, OR-ed per word before it is gathered."""
    at = F.pmod(F.xxhash64(column), F.lit(words * 64))
    rows = (ids.select((at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(words, dtype=np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out


def _fetcher(width: int, words):
    schema = pa.schema([("node", pa.int64()), ("grams", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.value
        bits = len(table) * 64
        for batch in batches:
            at = batch.column("at").to_numpy()
            possible = (table[at // 64] >> (at % 64)) & 1 == 1
            for part in portions([batch.filter(pa.array(possible))]):
                h, of = _sets(part, width)
                n = np.bincount(of, minlength=part.num_rows)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(_names(h, of, part.num_rows)[0]), pa.array(
                    [h[e - k:e].tobytes() for e, k in zip(ends, n)], pa.binary())], schema=schema)

    return fetch


def _overlaps(share):
    """Exact links among pairs that carry both sets."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("grams_a"), batch.column("grams_b"))):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate((x, y))
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                good[i] = share[1] * overlap >= share[0] * (len(x) + len(y) - overlap)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return count


def _grams(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and all its n-grams, for the nodes of ``wanted`` (node, doc_id)."""
    n = wanted.count()
    words = 64
    while words < FILTER_WORDS and words * 64 < 16 * n:
        words *= 2
    shared = docs.sparkSession.sparkContext.broadcast(_filter_words(wanted, "doc_id", words))
    grams = (docs.where("doc_id IS NOT NULL").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(words * 64)).alias("at"))
             .mapInArrow(_fetcher(width, shared), "node long, grams binary"))
    return stored(grams.join(wanted.select("node"), "node").dropDuplicates(["node"]), "grams")


def _sets_of(signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and bits of the sets in ``wanted`` (node), each once.

    A filter of bounded size lets only their rows, and few others, leave the
    tasks that read the signatures.
    """
    n, words = wanted.count(), 64
    while words < FILTER_WORDS and words * 64 < 16 * n:
        words *= 2
    at = F.pmod(F.xxhash64("node"), F.lit(words * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    marks = stored(wanted.select((at / 64).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("marks")), "marks")
    rows = signed.where("n > 0 AND doc_id IS NOT NULL").select("node", "bits", (at / 64).cast("int").alias("word"), bit.alias("bit"))
    some = rows.join(F.broadcast(marks), "word").where(F.col("marks").bitwiseAND(F.col("bit")) != 0)      # FILTER_WORDS rows at most
    return some.select("node", "bits").join(wanted.select("node"), "node").dropDuplicates(["node"])


def _needed(share):
    """Columns that two sets of sizes ``na`` and ``nb`` share if they link.

    Linked sets have ``least`` n-grams in common. Whichever prefix ends first,
    at most the rest of its set is common without being in both prefixes.
    Prefixes cut so that the rest is ``least - SHARED``, if they are that long,
    share ``SHARED`` columns, shorter ones what their own rest leaves.
    """
    a, b, c, d = F.col("na"), F.col("nb"), *(F.lit(x).cast("long") for x in share)
    least = F.floor((c * (a + b) + c + d - 1) / (c + d))
    largest = F.floor((c * F.greatest(a, b) + d - 1) / d)
    return F.least(F.lit(SHARED).cast("long"), least - largest + 1)


def _candidates(products: DataFrame, members: DataFrame, share) -> DataFrame:
    """Pairs (a, b, na, nb) that share enough columns; long ones, which yield no
    pairs, count as shared where both sets have them."""
    pairs = products.where(F.col("kind") == PAIR).groupBy("a", "b", "na", "nb").agg(F.sum("times").alias("times"))
    short = F.col("times") < _needed(share)
    if members.isEmpty():
        return pairs.where(~short)
    pairs = stored(pairs, "shared")
    long = stored(members.groupBy("node").agg(F.count(F.lit(1)).alias("long")), "long")
    more = (pairs.where(short).join(long.withColumnsRenamed({"node": "a", "long": "long_a"}), "a")
            .join(long.withColumnsRenamed({"node": "b", "long": "long_b"}), "b")
            .where(F.col("times") + F.least("long_a", "long_b") >= _needed(share)))
    return pairs.where(~short).unionByName(more.select(*pairs.columns))


def _links(docs: DataFrame, signed: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, share) -> DataFrame:
    """Links (a, b) among candidate pairs of sets."""
    pairs = stored(pairs.select("a", "b", "na", "nb").distinct(), "candidates")
    bits = stored(_sets_of(signed, stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")), "bits")
    with_bits = (pairs.join(bits.withColumnsRenamed({"node": "a", "bits": "bits_a"}), "a")
                 .join(bits.withColumnsRenamed({"node": "b", "bits": "bits_b"}), "b"))
    left = stored(with_bits.select("a", "b", "na", "nb", "bits_a", "bits_b")
                  .mapInArrow(_bounded(share), "a long, b long, na long, nb long"), "pairs")
    wanted = stored(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), "wanted")
    grams = _grams(docs, wanted, width)
    # A set with many pairs is most often `a` of them (see `_multiplier`); joined last, it is not copied.
    both = (left.join(grams.withColumnsRenamed({"node": "b", "grams": "grams_b"}), "b").select("a", "b", "grams_b")
            .join(grams.withColumnsRenamed({"node": "a", "grams": "grams_a"}), "a").select("a", "b", "grams_a", "grams_b"))
    return both.mapInArrow(_overlaps(share), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links and tag (a hash of the text) of every document.

    Words are what white space separates, A-Z lower-cased. A document is the
    set of its ``width``-word shingles; with fewer words all of them are one
    shingle. Documents link when ``share[1] * overlap >= share[0] * union``;
    component_id is the smallest doc_id reachable by links, itself included;
    n_links is the number of other documents, counted by doc_id and text, that
    the document links with. Links join documents of one component, so all
    pairs of a component are counted exactly, in blocks.

    Documents without words, with NULL or empty text have 0 shingles and link
    with nothing. A NULL doc_id has no place among ids: the row keeps its
    shingle count, has a NULL component and NULL links. Rows with one doc_id are judged
    by their own texts; they belong together only if their texts link.
    Repeated rows get the same result, an empty table gives no rows, further
    columns are ignored.
    """
    rows, signed, held = _held(docs, width, share)
    return _placed(signed, held, _link_counts(rows, signed, held, width, share))


def _held(docs: DataFrame, width: int, share) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, their signatures, and every set (node, doc_id) with its component."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_for(text_bytes(rows), BUCKET_BYTES)
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(rows.select("text"), width))
    signed = stored(rows.select("doc_id", "text", text_tag(F.col("text")).alias("tag")).mapInArrow(
        _signer(width, share, frequent), "doc_id long, tag long, n long, node long, prefix binary, bits binary, sketch binary"), "signed")
    # One node per different set, held by its smallest doc_id.
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stored(some.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    # Equal sets meet in the products and are one row there.
    entries = (some.select("node", "n", "prefix").mapInArrow(_dealer(parts), "part int, block binary")
               .groupBy("part").applyInArrow(_shared_columns, _ENTRY_FIELDS))
    products = stored(entries.join(some.select("node", "sketch").dropDuplicates(["node"]), "node")
                      .groupBy("part").applyInArrow(_multiplier(share), _PAIR_FIELDS), "products")
    members = stored(products.where(F.col("kind") == MEMBER).select(F.col("a").alias("gram"), F.col("b").alias("node"), F.col("na").alias("n")).distinct(), "long-columns")
    links = stored(_links(rows, signed, nodes, _candidates(products, members, share), width, share), "links")
    joined_up = components(links)
    if not members.isEmpty():
        for rest in (lambda: _to_pivot(_ranked(members, joined_up), share), lambda: _product(members, joined_up, signed, share)):
            links = stored(links.unionByName(_links(rows, signed, nodes, rest(), width, share)), "links")
            joined_up = components(links)
    held = stored(nodes.join(joined_up, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")), "held")
    return rows, signed, held


def _placed(signed: DataFrame, held: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    least = held.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = held.join(least, "component").select("node", "component_id")
    out = signed.join(placed if counts is None else placed.join(counts, "node"), "node", "left")
    known = F.col("doc_id").isNotNull()
    ids = F.when(known, F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    links = [] if counts is None else [F.when(known, F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0).cast("long"))).alias("n_links")]
    return out.select("doc_id", F.col("n").alias("n_shingles"), ids.alias("component_id"), *links, "tag")


def _link_counts(docs: DataFrame, signed: DataFrame, held: DataFrame, width: int, share) -> DataFrame:
    """node and n_links, from all pairs of sets inside a component.

    Components of up to ``BLOCK`` sets are dealt to tasks whole, larger ones in
    pairs of blocks. Tasks return sums per set, not pairs.
    """
    many = (signed.where("n > 0 AND doc_id IS NOT NULL").select("node", "doc_id", "tag").distinct()
            .groupBy("node").agg(F.count(F.lit(1)).alias("many")))
    sizes = held.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = stored(held.join(sizes, "component").join(many, "node")
                    .select("node", "doc_id", "component", "many", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "grouped")
    parts = parts_for(wanted.count(), BLOCK)
    large = F.col("blocks") > 1
    dealt = (wanted.join(_grams(docs, wanted, width), "node").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(parts))).alias("home"),
                     F.when(large, F.least("mine", "other")).otherwise(-1).alias("i"), F.when(large, F.greatest("mine", "other")).otherwise(-1).alias("j"),
                     (F.col("mine") > F.col("other")).alias("second"), "component", "node", "many", "grams"))
    linked = (dealt.groupBy("home", "i", "j").applyInArrow(_counter(share), "node long, links long")
              .groupBy("node").agg(F.sum("links").alias("links")))
    return stored(many.join(linked, "node", "left").select("node", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "counts")


def _common(gram: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlap of every left with every right set; ``owner`` counts through left, then right if it is another block."""
    same = left is right
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    count = np.diff(np.concatenate((start, [len(gram)])))
    # Frequent n-grams as a product of dense matrices, some at a time.
    often = np.flatnonzero(count > DENSE)
    for at in range(0, len(often), BLOCK):
        some = often[at:at + BLOCK]
        marks = np.zeros((len(left) + (0 if same else len(right)), len(some)), dtype=np.float32)
        where = np.repeat(start[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(count[some].sum())
        marks[owner[where], np.repeat(np.arange(len(some)), count[some])] = 1
        out += marks[:len(left)] @ (marks if same else marks[len(left):]).T
    # Rare ones pair by pair.
    rare = np.repeat((count > 1) & (count <= DENSE), count)
    ends = np.repeat(start + count, count)
    for step in range(1, int(count[(count <= DENSE)].max(initial=1))):
        x = np.flatnonzero(rare & (np.arange(len(gram)) + step < ends))
        p, q = np.minimum(owner[x], owner[x + step]), np.maximum(owner[x], owner[x + step])
        if same:
            p, q = np.concatenate((p, q)), np.concatenate((q, p))
        else:
            apart = (p < len(left)) & (q >= len(left))
            p, q = p[apart], q[apart] - len(left)
        np.add.at(out, (p, q), 1)
    return out


_COUNTED = pa.schema([("node", pa.int64()), ("links", pa.int64())])


def _counter(share):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        inside = key[1].as_py() == key[2].as_py()
        component, node, many = (group.column(c).to_numpy() for c in ("component", "node", "many"))
        second = group.column("second").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(g, "<u8") for g in group.column("grams").to_pylist()]
        n = np.array([len(x) for x in sets], dtype=np.int64)
        order = np.argsort(component, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], component[order][1:] != component[order][:-1], [True])))
        nodes, links = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            left = at if inside else at[~second[at]]
            right = left if inside else at[second[at]]
            if not len(left) or not len(right):
                continue
            both = left if inside else np.concatenate((left, right))
            overlap = _common(np.concatenate([sets[r] for r in both]), np.repeat(np.arange(len(both)), n[both]), left, right).astype(np.int64)
            good = share[1] * overlap >= share[0] * (n[left][:, None] + n[right][None, :] - overlap)
            if inside:
                np.fill_diagonal(good, False)
            nodes.append(node[left])
            links.append(good @ many[right])
            if not inside:
                nodes.append(node[right])
                links.append(many[left] @ good)
        flat_nodes, flat_links = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (nodes, links))
        return pa.Table.from_arrays([pa.array(flat_nodes), pa.array(flat_links)], schema=_COUNTED)

    return run


def one_of_each(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` with one document of every component: the one of smallest doc_id
    (then smallest hash of the text). Documents without words or without doc_id
    are in no group and stay, repeated rows of a document that stays are one."""
    _, signed, held = _held(docs, width, share)
    found = stored(_placed(signed, held).where("n_shingles > 0 AND doc_id IS NOT NULL"), "found")
    per = found.groupBy("component_id", "doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy(F.col("component_id").alias("of")).agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    judged = stored(per.join(first, F.col("component_id") == F.col("of")).select(
        "doc_id", "tag", "n", (F.struct("doc_id", "tag") == F.col("first")).alias("stays")), "judged")
    return once(docs, judged.where("stays AND n > 1"), judged.where("NOT stays"))


def _ranked(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of the long columns with their component, and whether it is the
    column's largest: gram, node, n, part, inner, pivot, n_pivot."""
    placed = stored(members.join(parts, "node", "left").select("gram", "node", "n", F.coalesce("component", "node").alias("part")), "members")
    largest = (placed.groupBy("gram", "part").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node"), "node", "n")).alias("first"))
               .groupBy("gram").agg(F.max(F.struct("size", "part", "first")).alias("top"))
               .select("gram", F.col("top.part").alias("largest"), F.col("top.first.node").alias("pivot"), F.col("top.first.n").alias("n_pivot")))
    return placed.join(largest, "gram").withColumn("inner", F.col("part") == F.col("largest"))


def _ordered(df: DataFrame, x: str, nx: str, y: str, ny: str) -> DataFrame:
    swap = F.col(x) > F.col(y)
    return df.select(
        F.when(swap, F.col(y)).otherwise(F.col(x)).alias("a"), F.when(swap, F.col(x)).otherwise(F.col(y)).alias("b"),
        F.when(swap, F.col(ny)).otherwise(F.col(nx)).alias("na"), F.when(swap, F.col(nx)).otherwise(F.col(ny)).alias("nb")).distinct()


def _fits(x: str, y: str, share):
    return F.lit(share[1]) * F.least(x, y) >= F.lit(share[0]) * F.greatest(x, y)


def _to_pivot(ranked: DataFrame, share) -> DataFrame:
    """Every document of a long column outside its largest component, with one document inside."""
    return _ordered(ranked.where(~F.col("inner") & _fits("n", "n_pivot", share)), "node", "n", "pivot", "n_pivot")


def _product(members: DataFrame, parts: DataFrame, signed: DataFrame, share, block: int | None = None) -> DataFrame:
    """Pairs of long columns from different components that the bounds allow.

    The documents of a column are dealt to blocks of about ``block``; a task
    multiplies the bit maps of two blocks. Only pairs that pass leave the task,
    and of the columns that a pair shares, the first one yields it. Columns
    within one component are done.
    """
    block = block or BLOCK
    placed = stored(members.join(parts, "node", "left").select("gram", "node", "n", F.coalesce("component", "node").alias("part")), "members")
    sizes = (placed.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("first"), F.max("part").alias("last"))
             .where("first < last").select("gram", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # The long columns of a document; they are part of its prefix, so few.
    columns = members.groupBy("node").agg(F.sort_array(F.collect_set("gram")).alias("columns"))
    open_columns = stored(placed.join(sizes, "gram"), "open-columns")
    bits = _sets_of(signed, stored(open_columns.select("node").distinct(), "named"))
    dealt = (open_columns.join(bits, "node").join(columns, "node").withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("gram", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                     (F.col("mine") > F.col("other")).alias("second"), "node", "n", "part", "bits", "columns"))
    return dealt.groupBy("gram", "i", "j").applyInArrow(_block_product(share), "a long, b long, na long, nb long")


_FOUND = pa.schema([(c, pa.int64()) for c in ("a", "b", "na", "nb")])


def _block_product(share):
    def multiply(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        inside = key[1].as_py() == key[2].as_py()
        node, n, part = (group.column(c).to_numpy() for c in ("node", "n", "part"))
        second = group.column("second").to_numpy(zero_copy_only=False)
        lists = group.column("columns").combine_chunks()
        offsets, grams = lists.offsets.to_numpy(), lists.values.to_numpy()
        gram = key[0].as_py()

        def first_shared(r, q):
            x, y = grams[offsets[r]:offsets[r + 1]], grams[offsets[q]:offsets[q + 1]]
            return x[np.isin(x, y)][0] == gram

        maps = [np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()]
        # Maps of one size are one matrix; a larger map is folded to the size of a smaller one.
        sizes = np.array([len(m) for m in maps])
        out = []

        def matrix(rows, size):
            words = np.stack([_folded(maps[r], size) for r in rows]).view("<u8")
            return words, n[rows] - np.bitwise_count(words).sum(axis=1, dtype=np.int64)

        classes = np.unique(sizes)
        for small in classes:
            for large in classes[classes >= small]:
                x, y = np.flatnonzero(sizes == small), np.flatnonzero(sizes == large)
                if n[x].max() * share[1] < share[0] * n[y].min():
                    continue
                left, left_unseen = matrix(x, small)
                right, right_unseen = (left, left_unseen) if small == large else matrix(y, small)
                for k, r in enumerate(x):
                    if small == large:
                        c = np.arange(k + 1, len(y))
                    else:
                        c = np.arange(len(y))
                    c = c[part[y[c]] != part[r]]
                    if not inside:
                        c = c[second[y[c]] != second[r]]
                    total = n[y[c]] + n[r]
                    least = (share[0] * total + sum(share) - 1) // sum(share)
                    c, least = c[np.minimum(n[y[c]], n[r]) >= least], least[np.minimum(n[y[c]], n[r]) >= least]
                    if len(c):
                        bound = np.bitwise_count(right[c] & left[k]).sum(axis=1, dtype=np.int64) + np.minimum(right_unseen[c], left_unseen[k])
                        for q in y[c[bound >= least]]:
                            first, last = (r, q) if node[r] < node[q] else (q, r)
                            if first_shared(r, q):
                                out.append((node[first], node[last], n[first], n[last]))
        columns = np.array(out, dtype=np.int64).reshape(len(out), 4)
        return pa.Table.from_arrays([pa.array(columns[:, i]) for i in range(4)], schema=_FOUND)

    return multiply
