"""Removal of repeated passages with a logarithmic family of suffix arrays.

A passage is a run of ``length`` bytes that also starts in a document of
smaller doc_id. The index holds suffixes at sampled positions only: in every
window of ``length`` bytes the k-gram of least hash is an anchor, so two equal
windows, wherever they stand, have the same anchor at the same place. Windows
next to each other mostly share their anchor; such a run of windows is one
index entry (anchor, fingerprint of all bytes of the run, document, position),
about one for every 15 bytes.

* Entries are dealt to buckets by anchor. A bucket takes them in batches; each
  batch becomes a sorted suffix array, is merge-scanned against the existing
  levels, and levels of equal size are merged, so that an entry is moved a
  logarithmic number of times. A run met in two documents is settled at once:
  the later document loses it. Levels keep only the first document of a run.
* Anchors found with different surroundings (the edge of a passage, a phrase
  used by chance) cannot be settled run by run. Their bytes are fetched once
  and compared window by window.

Copies of a run inside one map task are settled there, and anchors that meet
many different surroundings are dealt by window instead of by anchor, so
neither a passage nor a phrase that a third of all documents share gathers in
one task. Documents travel once, bucketed by doc_id and text, for fetching and
removal. Identical rows are one text with a count by then, as far as a map task
sees them, and rows without doc_id do not travel at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scoreloom.functions import hashing
from scoreloom.llm.runtime import parts_for, text_bytes
from scoreloom.llm.textvec import ODD, U64, flat, hash_runs, mix, portions

LENGTH = 50
GRAM = 20
BUCKET_BYTES = 8 << 20     # text behind one bucket
GATHER_BYTES = 16 << 20     # text a map task turns into one row per bucket
LEVEL_ROWS = 1 << 17        # least rows of a batch that becomes a level
HOT_LOCAL = 64              # surroundings of an anchor in one gathering beyond which it is dealt by window
HOT_BUCKET = 4096           # the same, in a bucket
REPEAT_BYTES = 8 << 20      # identical rows a map task holds before it passes them on
COPIES = 10_000             # rows that one step of spelling out identical rows makes
SEED = 42
COVERED, OPEN, HOT = 0, 1, 2
_LOW24 = U64((1 << 24) - 1)


# --- rows as compressed planes of bytes ----------------------------------------

def pack(**columns: np.ndarray) -> bytes:
    """Columns of one length (and ``raw`` bytes) as one compressed block."""
    parts, head = [], []
    for name, values in columns.items():
        data = np.ascontiguousarray(values)
        head.append(f"{name}:{data.dtype.str}:{len(data)}")
        # Byte planes: the high bytes of small numbers compress to nothing.
        parts.append(np.ascontiguousarray(data.view(np.uint8).reshape(len(data), data.dtype.itemsize).T).tobytes())
    body = b"".join(parts)
    top = f"{len(body)};{','.join(head)}\n".encode()
    return top + pa.compress(body, codec="zstd", asbytes=True)


def unpack(block: bytes) -> dict[str, np.ndarray]:
    top, _, body = block.partition(b"\n")
    size, _, head = top.decode().partition(";")
    data = np.frombuffer(pa.decompress(body, int(size), codec="zstd", asbytes=True), dtype=np.uint8)
    out, at = {}, 0
    for field in head.split(","):
        name, kind, n = field.split(":")
        n, kind = int(n), np.dtype(kind)
        planes = data[at:at + n * kind.itemsize].reshape(kind.itemsize, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        at += n * kind.itemsize
    return out


def joined(blocks: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([b[name] for b in blocks]) for name in blocks[0]}


def taken(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {name: values[which] for name, values in rows.items()}


def bucket_column(doc_id: Column, tag: Column, n: int) -> Column:
    """The bucket of a text, named by its doc_id and tag."""
    key = doc_id.bitwiseXOR(tag * F.lit(hashing.MULTIPLIERS[0]).cast("long"))
    return F.pmod(hashing.mix(key, SEED), F.lit(n)).cast("int")


def doc_bucket(doc_id: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    """The same numbers as ``bucket_column`` gives in Spark."""
    mask = U64(hashing.MASK)
    key = doc_id.astype(np.int64) ^ tag.astype(np.int64) * np.int64(hashing.MULTIPLIERS[0])
    x = (key.view(U64) ^ (key >> 32).view(U64) ^ U64(SEED)) & mask
    for multiplier, shift in zip(hashing.MULTIPLIERS, (16, 15)):
        x = ((x ^ (x >> U64(shift))) * U64(multiplier)) & mask
    return ((x ^ (x >> U64(16))) % U64(n)).astype(np.int64)


def row_key(doc_id: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Identity of a text: its doc_id and a tag of its bytes."""
    return mix(doc_id.astype(np.int64).view(U64) * U64(ODD[0]) + tag.astype(U64) * U64(ODD[4]))


# --- anchors -----------------------------------------------------------------

def _words64(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every offset as one number."""
    n = len(raw)
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    out = np.empty(n, dtype=U64)
    for o in range(min(8, n)):
        count = (n - o + 7) // 8
        out[o::8] = np.frombuffer(padded[o:o + 8 * count].tobytes(), dtype="<u8")
    return out


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    words, n = _words64(raw), len(raw) - k + 1
    h = np.zeros(n, dtype=U64)
    offsets = [*range(0, k - 7, 8)]
    if offsets[-1] != k - 8:
        offsets.append(k - 8)
    for o in offsets:
        h = (h ^ words[o:o + n]) * U64(ODD[0])
        h ^= h >> U64(29)
    return mix(h)


def window_hashes(raw: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from every place in ``begin``."""
    words, h = _words64(raw), np.zeros(len(begin), dtype=U64)
    for o in (*range(0, length - 7, 8), length - 8):
        h = (h ^ words[begin + o]) * U64(ODD[0])
        h ^= h >> U64(29)
    return mix(h)


def anchor_runs(raw: np.ndarray, starts: np.ndarray, length: int, k: int):
    """Runs of windows with one anchor: text, first window, windows, anchor, fingerprint."""
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    least, span, wide = gram_hashes(raw, k), 1, length - k + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        rest = wide - span
        least = np.minimum(least[:-rest], least[rest:])
    least = least[:n]
    inside = np.zeros(n + 1, dtype=np.int32)
    size = np.diff(starts)
    fits = np.flatnonzero(size >= length)
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, starts[fits] + size[fits] - length + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    first = np.zeros(n + 1, dtype=bool)
    first[1:n] = least[1:] != least[:-1]
    first[starts[fits]] = True
    edges = np.flatnonzero(first[:n] & valid)
    stop = np.flatnonzero(np.concatenate((first[:n] | ~valid, [True])))
    after = stop[np.searchsorted(stop, edges, side="right")]
    text = np.searchsorted(starts, edges, side="right") - 1
    # The text of an offset is the last one that starts there; empty texts hold no window.
    prints = hash_runs(raw, edges, after - 1 + length)
    return text, edges - starts[text], after - edges, mix(least[edges] ^ U64(ODD[5])), prints


def _settle(rows: dict[str, np.ndarray]):
    """Sort by (key, rest, doc_id); split off rows whose run has a smaller document."""
    rows = taken(rows, np.lexsort((rows["doc"], rows["rest"], rows["key"])))
    new = np.ones(len(rows["key"]), dtype=bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["rest"][1:] != rows["rest"][:-1])
    group = np.cumsum(new) - 1
    first = rows["doc"][np.flatnonzero(new)][group] if len(group) else rows["doc"]
    later = rows["doc"] > first
    return taken(rows, ~later), taken(rows, later)


def _surroundings(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Different runs with the anchor of each row; rows are sorted by (key, rest)."""
    if not len(rows["key"]):
        return np.zeros(0, np.int64)
    gram = rows["key"] >> U64(24)
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    new_run = np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["rest"][1:] != rows["rest"][:-1])))
    which = np.cumsum(new_gram) - 1
    return np.bincount(which[new_run])[which]


def _to_documents(rows: dict[str, np.ndarray], status, buckets: int, parts: int):
    """Rows for the buckets of their documents; target -(1 + bucket)."""
    if not len(rows["doc"]):
        return
    status = np.broadcast_to(np.uint8(status), rows["doc"].shape)
    at = doc_bucket(rows["doc"], rows["tag"], buckets)
    order = np.lexsort((rows["start"], rows["tag"], rows["doc"], at))
    at = at[order]
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
    home = ((rows["key"] >> U64(24)) % U64(parts)).astype(np.uint32)
    home = np.where(status == OPEN, home, 0).astype(np.uint32)
    for a, b in zip(cuts[:-1], cuts[1:]):
        w = order[a:b]
        yield -(1 + int(at[a])), pack(
            doc=np.diff(rows["doc"][w], prepend=0), tag=rows["tag"][w], start=rows["start"][w],
            n=rows["n"][w], status=np.ascontiguousarray(status[w]), home=home[w])


def _rows_of(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return block | {"doc": np.cumsum(block["doc"])}


_TARGETS = pa.schema([("target", pa.int32()), ("block", pa.binary())])


def _batch(rows, schema=_TARGETS) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)


def _indexer(length: int, k: int, parts: int, buckets: int):
    def flush(pieces):
        rows, later = _settle(joined(pieces))
        yield from _to_documents(later, COVERED, buckets, parts)
        hot = _surroundings(rows) > HOT_LOCAL
        if hot.any():
            # Compared window by window; the home bucket of the anchor only learns of it.
            yield from _to_documents(taken(rows, hot), HOT, buckets, parts)
            grams = np.unique(rows["key"][hot] >> U64(24))
            mark = {"key": grams << U64(24) | _LOW24, "rest": np.full(len(grams), (1 << 24) - 1, np.uint32),
                    "doc": np.zeros(len(grams), np.int64), "tag": np.zeros(len(grams), np.uint32),
                    "start": np.zeros(len(grams), np.uint32), "n": np.zeros(len(grams), np.uint32)}
            rows = joined([taken(rows, ~hot), mark])
        home = ((rows["key"] >> U64(24)) % U64(parts)).astype(np.int64)
        order = np.lexsort((rows["start"], rows["tag"], rows["doc"], home))
        home = home[order]
        cuts = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            r = taken(rows, order[a:b])
            # The documents of the block once, then a small number per row.
            key = row_key(r["doc"], r["tag"])
            new = np.concatenate(([True], key[1:] != key[:-1]))
            yield int(home[a]), pack(
                docs=np.diff(r["doc"][new], prepend=0), tags=r["tag"][new], of=np.diff(np.cumsum(new) - 1, prepend=0).astype(np.uint16),
                key=r["key"], rest=np.ascontiguousarray(r["rest"].astype("<u4")), start=r["start"], n=r["n"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in portions(_distinct(batches)):
            raw, starts = flat(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy().astype(np.uint32)
            text, start, n, gram, print_ = anchor_runs(raw, starts, length, k)
            if len(text):
                pieces.append({
                    "key": gram >> U64(24) << U64(24) | print_ >> U64(40), "rest": (print_ & _LOW24).astype(np.uint32),
                    "doc": ids[text].astype(np.int64), "tag": tags[text], "start": start.astype(np.uint32), "n": n.astype(np.uint32)})
            held += len(raw)
            if held >= GATHER_BYTES and pieces:
                yield _batch(flush(pieces))
                pieces, held = [], 0
        if pieces:
            yield _batch(flush(pieces))

    return index


# --- the logarithmic family ----------------------------------------------------

class SuffixLevels:
    """Sorted arrays of first occurrences, each about twice as long as the next.

    ``add`` scans a batch against every level and returns the rows that an
    earlier document covers, from the batch or from the levels.
    """

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, batch: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
        batch, later = _settle(batch)
        batch["multi"] = _surroundings(batch) > 1
        covered = [later]
        for i, level in enumerate(self.levels):
            gone, dead = self._scan(level, batch)
            covered += [taken(batch, gone), taken(level, dead)]
            batch = taken(batch, ~gone)
            if dead.any():
                self.levels[i] = taken(level, ~dead)
        self.levels.append(batch)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]["key"]) > len(self.levels[-2]["key"]):
            self._merge()
        return covered

    def _merge(self):
        rows = joined(self.levels[-2:])
        self.levels[-2:] = [taken(rows, np.lexsort((rows["rest"], rows["key"])))]

    @staticmethod
    def _scan(level, batch):
        """Which batch rows and which level rows are covered; marks anchors with several runs."""
        keys, want = level["key"], batch["key"]
        dead = np.zeros(len(keys), dtype=bool)
        if not len(keys) or not len(want):
            return np.zeros(len(want), dtype=bool), dead
        left = np.searchsorted(keys, want, side="left")
        right = np.searchsorted(keys, want, side="right")
        at = np.minimum(left, len(keys) - 1)
        same = (left < right) & (level["rest"][at] == batch["rest"]) & (level["rest"][np.maximum(right, 1) - 1] == batch["rest"])
        gone = same & (level["doc"][at] < batch["doc"])
        beats = np.flatnonzero(same & (level["doc"][at] > batch["doc"]))
        edge = np.zeros(len(keys) + 1, dtype=np.int64)
        np.add.at(edge, left[beats], 1)
        np.add.at(edge, right[beats], -1)
        dead = np.cumsum(edge[:-1]) > 0
        gram = want >> U64(24) << U64(24)
        low, high = np.searchsorted(keys, gram, side="left"), np.searchsorted(keys, gram | _LOW24, side="right")
        other = (high > low) & ~(same & (low == left) & (high == right))
        batch["multi"] |= other
        edge = np.zeros(len(keys) + 1, dtype=np.int64)
        np.add.at(edge, low[other], 1)
        np.add.at(edge, high[other], -1)
        level["multi"] |= np.cumsum(edge[:-1]) > 0
        return gone, dead

    def open_rows(self) -> dict[str, np.ndarray] | None:
        """First occurrences of runs whose anchor has other surroundings too."""
        while len(self.levels) > 1:
            self._merge()
        if not self.levels:
            return None
        rows = self.levels[0]
        # A mark says that a map task dealt the anchor by window; then all of it is.
        gram = rows["key"] >> U64(24)
        rows["many"] = (_surroundings(rows) > HOT_BUCKET) | np.isin(gram, gram[rows["n"] == 0])
        return taken(rows, rows["multi"] & (rows["n"] > 0))


def _leveller(parts: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_pylist()
        if key[0].as_py() < 0:
            return pa.Table.from_batches([_batch((key[0].as_py(), b) for b in blocks)])
        family, out, waiting, held = SuffixLevels(), [], [], 0

        def add():
            for rows in family.add(joined(waiting)):
                rows = taken(rows, rows["n"] > 0)
                out.extend(_to_documents(rows, COVERED, buckets, parts))

        for block in blocks:
            b = unpack(block)
            of = np.cumsum(b["of"].astype(np.int64))
            waiting.append({"key": b["key"], "rest": b["rest"], "doc": np.cumsum(b["docs"])[of], "tag": b["tags"][of],
                            "start": b["start"], "n": b["n"]})
            held += len(of)
            if held >= LEVEL_ROWS:
                add()
                waiting, held = [], 0
        if waiting:
            add()
        rows = family.open_rows()
        if rows is not None:
            out.extend(_to_documents(rows, np.where(rows["many"], HOT, OPEN).astype(np.uint8), buckets, parts))
        return pa.Table.from_batches([_batch(out)])

    return run


# --- identical rows ------------------------------------------------------------

_COUNTED = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("tag", pa.int64()), ("n", pa.int64())])


def _keys(batch: pa.RecordBatch):
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, tags, row_key(ids, tags)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without rows that repeat an earlier one of the batch."""
    for batch in batches:
        ids, _, key = _keys(batch)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        seen, keep = set(), np.ones(batch.num_rows, dtype=bool)
        texts = batch.column("text")
        for i in np.flatnonzero(count[which] > 1):
            name = int(ids[i]), texts[i].as_py()
            keep[i] = name not in seen
            seen.add(name)
        yield batch if keep.all() else batch.filter(pa.array(keep))


def _counter():
    """Identical rows of a map task as one row with their number."""
    def passed_on(held):
        columns = zip(*((doc, text, tag, n) for (doc, text), (tag, n) in held.items()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            ids, tags, key = _keys(batch)
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            again = count[which] > 1
            if held:
                again |= np.isin(key, row_key(np.array([d for d, _ in held], np.int64), np.array([t for t, _ in held.values()], np.int64)))
            texts = batch.column("text")
            for i in np.flatnonzero(again):
                name = int(ids[i]), texts[i].as_py()
                if name not in held:
                    size += len(name[1] or b"") + 64
                held[name] = int(tags[i]), held.get(name, (0, 0))[1] + 1
            rest = pa.array(~again)
            single = [batch.column(c).filter(rest) for c in ("doc_id", "text", "tag")]
            yield pa.RecordBatch.from_arrays([*single, pa.array(np.ones(len(single[0]), np.int64))], schema=_COUNTED)
            if size >= REPEAT_BYTES:
                yield passed_on(held)
                held, size = {}, 0
        if held:
            yield passed_on(held)

    return run


def _spelled_out(rows: DataFrame) -> DataFrame:
    """Every row as often as its ``n`` says, in steps that bound the arrays."""
    names = [c for c in rows.columns if c != "n"]
    steps = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("__step"))
    left = F.least(F.col("n") - F.col("__step") * COPIES, F.lit(COPIES)).cast("int")
    return steps.select(*names, F.explode(F.sequence(F.lit(1), left)).alias("__copy")).select(*names)


# --- windows of anchors with several surroundings --------------------------------

def _spans_of(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of intervals per row, as (row, start, end) in order."""
    order = np.lexsort((start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(row):
        return row, start, end
    reach = int(end.max()) + 1
    top = np.maximum.accumulate(row * reach + end)
    new = np.concatenate(([True], row[1:] * reach + start[1:] > top[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(row) - 1]))
    return row[new], start[new], top[last] - row[new] * reach


def _texts(docs: pa.Table):
    """Bytes, offsets and keys of the documents of a bucket."""
    raw, starts = flat(docs.column("text"))
    ids = docs.column("doc_id")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    valid = np.asarray(ids.is_valid())
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    tags = docs.column("tag").to_numpy().astype(np.uint32)
    return raw, starts, ids, tags, valid


def _located(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of every wanted key, the first of equal ones."""
    order = np.argsort(keys, kind="stable")
    return order[np.searchsorted(keys[order], wanted, side="left")]


def _done(doc, tag, start, end, buckets):
    rows = {"doc": doc, "tag": tag, "start": start.astype(np.uint32), "n": (end - start).astype(np.uint32), "key": np.zeros(len(doc), U64)}
    return _to_documents(rows, COVERED, buckets, 1)


def _fetcher(length: int, parts: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
        blocks = [_rows_of(unpack(b)) for b in spans.column("block").to_pylist()]
        if not blocks or not docs.num_rows:
            return pa.Table.from_batches([], schema=_TARGETS)
        rows = joined(blocks)
        raw, starts, ids, tags, valid = _texts(docs)
        keys = np.where(valid, row_key(ids, tags), U64(0))
        row = _located(keys, row_key(rows["doc"], rows["tag"]))
        out = []
        sure = rows["status"] == COVERED
        r, a, b = _spans_of(row[sure], rows["start"][sure], rows["start"][sure].astype(np.int64) + rows["n"][sure] + length - 1)
        out.extend(_done(ids[r], tags[r], a, b, buckets))
        for status in (OPEN, HOT):
            which = np.flatnonzero(rows["status"] == status)
            at, n, start = row[which], rows["n"][which].astype(np.int64), rows["start"][which].astype(np.int64)
            if status == HOT:
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at, start, n = np.repeat(at, n), np.repeat(start, n) + step, np.ones(int(n.sum()), np.int64)
                home = (window_hashes(raw, starts[at] + start, length) % U64(parts)).astype(np.int64) if len(at) else at
            else:
                home = rows["home"][which].astype(np.int64)
            if not len(at):
                continue
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], home[order][1:] != home[order][:-1], [True])))
            for x, y in zip(cuts[:-1], cuts[1:]):
                w = order[x:y]
                size = n[w] + length - 1
                index = np.repeat(starts[at[w]] + start[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out.append((int(home[w[0]]), pack(doc=ids[at[w]], tag=tags[at[w]], start=start[w].astype(np.uint32),
                                                  n=n[w].astype(np.uint32), raw=raw[index])))
        return pa.Table.from_batches([_batch(out)])

    return run


def _later(h: np.ndarray, doc: np.ndarray):
    """Windows in order of hash and document; the first of each hash; which come from a later document than it."""
    order = np.lexsort((doc, h))
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    lead = order[new][np.cumsum(new) - 1]
    return order, lead, doc[order] > doc[lead]


def later_windows(raw: np.ndarray, begin: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Windows whose bytes also stand in a smaller document; hashes propose, bytes decide."""
    if not len(begin):
        return np.zeros(0, np.int64)
    h = window_hashes(raw, begin, length)
    order, lead, later = _later(h, doc)
    words, same = _words64(raw), np.ones(len(order), dtype=bool)
    for o in (*range(0, length - 7, 8), length - 8):
        same &= words[begin[order] + o] == words[begin[lead] + o]
    if same.all():
        return order[later]
    # Different windows met under one hash: those hashes are told apart by their bytes.
    mixed = np.isin(h, h[order[~same]])
    sure = order[later & ~mixed[order]]
    members = np.flatnonzero(mixed)
    spelled = np.ascontiguousarray(raw[begin[members][:, None] + np.arange(length)])
    _, exact = np.unique(spelled.view(f"V{length}").ravel(), return_inverse=True)
    order, _, later = _later(exact, doc[members])
    return np.concatenate((sure, members[order[later]]))


def _comparer(length: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        target, blocks = key[0].as_py(), group.column("block").to_pylist()
        if target < 0:
            return pa.Table.from_batches([_batch((target, b) for b in blocks)])
        rows = joined([unpack(b) for b in blocks])
        n = rows["n"].astype(np.int64)
        size = n + length - 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(np.cumsum(size) - size, n) + step
        owner = np.repeat(np.arange(len(n)), n)
        doc = rows["doc"][owner]
        again = later_windows(rows["raw"], begin, doc, length)
        texts = row_key(rows["doc"], rows["tag"])
        _, one, which = np.unique(texts, return_index=True, return_inverse=True)
        start = rows["start"][owner[again]].astype(np.int64) + step[again]
        r, a, b = _spans_of(which[owner[again]], start, start + length)
        return pa.Table.from_batches([_batch(_done(rows["doc"][one[r]], rows["tag"][one[r]], a, b, buckets))])

    return run


def _remover():
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("n", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, spans: pa.Table) -> pa.Table:
        raw, starts, ids, tags, valid = _texts(docs)
        n = len(ids)
        begin = end = owner = np.zeros(0, np.int64)
        if spans.num_rows and n:
            rows = joined([_rows_of(unpack(b)) for b in spans.column("block").to_pylist()])
            # Repeated rows share their spans: work by distinct text, then deal out.
            keys = np.where(valid, row_key(ids, tags), U64(0))
            distinct, which = np.unique(keys, return_inverse=True)
            at = np.searchsorted(distinct, row_key(rows["doc"], rows["tag"]))
            r, a, b = _spans_of(at, rows["start"], rows["start"].astype(np.int64) + rows["n"])
            count = np.bincount(r, minlength=len(distinct))
            first = np.cumsum(count) - count
            mine = count[which]
            pick = np.repeat(first[which] - (np.cumsum(mine) - mine), mine) + np.arange(mine.sum())
            owner, begin, end = np.repeat(np.arange(n), mine), a[pick], b[pick]
        mark = np.zeros(len(raw) + 1, dtype=np.int32)
        np.add.at(mark, starts[owner] + begin, 1)
        np.add.at(mark, starts[owner] + end, -1)
        keep = np.cumsum(mark[:-1]) == 0
        kept_raw = raw[keep]
        offsets = np.concatenate(([0], np.cumsum(keep)))[starts]
        per = np.bincount(owner, minlength=n)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))], ["start", "end"]))
        kept = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(kept_raw.tobytes())])
        return pa.Table.from_arrays([pa.array(ids, mask=~valid), pa.array(np.diff(starts)), lists, kept.cast(pa.binary()),
                                     docs.column("n").combine_chunks()], schema=schema)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (byte offsets, end exclusive) and the bytes kept.

    Removes every byte of a ``length``-byte string that also starts in a
    document with a smaller doc_id; strings are judged on the input.

    NULL text counts as empty. A row without doc_id has no order: it removes
    nothing, loses nothing and passes by all shuffles. Rows with the same
    doc_id do not remove from each other, repeated rows get the same result;
    they travel as one text and a count, so any share of the rows may have one
    id. Texts shorter than ``length`` are kept whole, an empty table gives no
    rows, further columns are ignored.
    """
    if not 8 <= gram <= length:
        raise ValueError("the sampled k-gram must have 8 to `length` bytes")
    size = text_bytes(docs)
    parts = buckets = parts_for(size, bucket_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"))
    named = rows.where("doc_id IS NOT NULL")
    counted = named.mapInArrow(_counter(), "doc_id long, text binary, tag long, n long")
    placed = counted.withColumn("target", -1 - bucket_column(F.col("doc_id"), F.col("tag"), buckets))
    fields = "target int, block binary"
    entries = named.mapInArrow(_indexer(length, gram, parts, buckets), fields)
    settled = entries.groupBy("target").applyInArrow(_leveller(parts, buckets), fields)
    by_document = placed.groupBy("target")
    opened = by_document.cogroup(settled.groupBy("target")).applyInArrow(_fetcher(length, parts, buckets), fields)
    spans = opened.groupBy("target").applyInArrow(_comparer(length, buckets), fields)
    span = "array<struct<start: long, end: long>>"
    kept = by_document.cogroup(spans.groupBy("target")).applyInArrow(
        _remover(), f"doc_id long, n_bytes long, spans {span}, kept binary, n long")
    whole = F.coalesce(F.col("text"), F.lit(b""))
    unnamed = rows.where("doc_id IS NULL").select(
        "doc_id", F.octet_length(whole).cast("long").alias("n_bytes"), F.array().cast(span).alias("spans"), whole.alias("kept"))
    return _spelled_out(kept).unionAll(unnamed)
