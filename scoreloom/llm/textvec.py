"""Vectorised text primitives over the byte buffer of an Arrow batch.

All functions work on one flat ``uint8`` array that holds the texts of a batch
back to back, with ``starts`` giving the offset of every text (one more entry
than texts). They run inside Spark tasks; nothing here keeps state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Odd 64-bit mixing constants.
ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
       0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
MAX_BATCH_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(ODD[1])
    x = (x ^ (x >> U64(27))) * U64(ODD[2])
    return x ^ (x >> U64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def portions(batches, column: str = "text", limit: int = MAX_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds more than ``limit`` text bytes, unless a
    single text is longer: the memory of a task stays bounded by the longest text."""
    for batch in batches:
        lengths = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(lengths.buffers()[1], dtype=np.int64)[lengths.offset:lengths.offset + len(lengths) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def words_of(raw: np.ndarray, starts: np.ndarray, is_word: np.ndarray):
    """Begin, end and text index of every maximal run of bytes in ``is_word``.

    ``is_word`` is a table of 256 truth values; runs end with their text.
    """
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = is_word[raw]
    change = inside[1:] != inside[:-1]
    begin_flag = change & inside[1:]
    end_flag = change & inside[:-1]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    begin_flag[both] = True
    end_flag[both] = True
    begin, end = np.flatnonzero(begin_flag), np.flatnonzero(end_flag)
    text = np.searchsorted(starts, begin, side="right") - 1
    return begin, end, text


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of them."""
    size = max(_POWERS, default=0)
    if size < n:
        size = max(1 << 16, n + n // 8)
        base = ODD[0]
        inverse = pow(base, -1, 1 << 64)
        one = np.ones(size, dtype=U64)
        up, down = one * U64(base), one * U64(inverse)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = (np.cumprod(up), np.cumprod(down))
    return _POWERS[size]


_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def hash_runs(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[begin:end] for every run; equal bytes, equal hash."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_TABLE[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * U64(ODD[3]))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return _LOWER[raw]


def shingle_hashes(words: np.ndarray, text: np.ndarray, n_texts: int, width: int):
    """Hashes of ``width`` consecutive words, or of all words of a shorter text.

    Returns the hash and the text of each shingle, in order of position.
    """
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(count)))
    total = len(words)
    full = max(total - width + 1, 0)
    h = np.zeros(full, dtype=U64)
    for k in range(width):
        h = h * U64(ODD[0]) + words[k:k + full] * U64(ODD[4])
    same = text[:full] == text[width - 1:width - 1 + full] if full else np.zeros(0, bool)
    hashes, owner = mix(h[same]), text[:full][same]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), dtype=U64)
        for k in range(width - 1):
            has = count[short] > k
            at = np.minimum(first[short] + k, total - 1)
            extra = np.where(has, extra * U64(ODD[0]) + words[at] * U64(ODD[5]), extra)
        extra = mix(extra + count[short].astype(U64))
        hashes, owner = np.concatenate((hashes, extra)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner
