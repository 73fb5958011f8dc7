"""Word-piece counts by a linear longest-match automaton.

The vocabulary becomes a byte trie. Every node has a failure link (where
matching goes on when the next byte has no child) and the number of pieces
that are complete, hence popped, on the way. A word is then counted in one
pass over its bytes without building a piece. Words are separated by white
space and matched with one leading space, as the vocabulary spells them.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scoreloom.llm.textvec import NOT_SPACE, flat, hash_runs, portions, words_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 1 << 20


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file (base64 piece, blank, rank per line)."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Longest-match automaton over bytes; every single byte is a piece."""

    def __init__(self, pieces):
        self.next: dict[int, int] = {}
        final, depth_first = [False], [[]]
        for piece in {*pieces, *(bytes([b]) for b in range(256))}:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                child = self.next.get(key)
                if child is None:
                    child = self.next[key] = len(final)
                    final.append(False)
                    depth_first.append([])
                    depth_first[node].append((byte, child))
                node = child
            if node:
                final[node] = True
        self.fail, self.popped = [0] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in depth_first[parent]:
                queue.append(node)
                if final[node]:
                    # The whole string is one piece; matching restarts at the root.
                    self.popped[node], self.fail[node] = 1, 0
                    continue
                popped, at = self.popped[parent], self.fail[parent]
                while at << 8 | byte not in self.next:
                    popped += self.popped[at]
                    at = self.fail[at]
                self.popped[node], self.fail[node] = popped, self.next[at << 8 | byte]

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split of ``word``."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in word:
            child = step.get(node << 8 | byte)
            while child is None:
                total += popped[node]
                node = fail[node]
                child = step.get(node << 8 | byte)
            node = child
        while node:
            total += popped[node]
            node = fail[node]
        return total


_BUILT: dict[str, Automaton] = {}


def _counter(pieces, name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The automaton outlives the task in a reused worker.
        automaton = _BUILT.get(name)
        if automaton is None:
            _BUILT.clear()
            automaton = _BUILT[name] = Automaton(pieces.value)
        known: dict[int, int] = {}
        for batch in portions(batches):
            raw, starts = flat(batch.column("text"))
            begin, end, owner = words_of(raw, starts, NOT_SPACE)
            distinct, at, which = np.unique(hash_runs(raw, begin, end), return_index=True, return_inverse=True)
            data = raw.tobytes()
            if len(known) > CACHE:
                known.clear()
            sizes = np.zeros(len(distinct), dtype=np.int64)
            for i, h in enumerate(distinct.tolist()):
                size = known.get(h)
                if size is None:
                    size = known[h] = automaton.count(b" " + data[begin[at[i]]:end[at[i]]])
                sizes[i] = size
            n = batch.num_rows
            tokens = np.bincount(owner, sizes[which], n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(starts)),
                pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(tokens)], schema=schema)

    return count


def token_counts(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """doc_id, n_bytes, n_words and n_tokens of every text.

    A NULL or empty text, or one of blanks only, has 0 words and 0 tokens. A
    NULL doc_id is kept, repeated rows are counted each, further columns are
    ignored, an empty table gives no rows. Time is linear in the text also for
    a single word of any length. The vocabulary is a file of fixed size and is
    the only thing broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(pieces))
    name = hashlib.sha256(b"\n".join(pieces)).hexdigest()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_counter(shared, name), "doc_id long, n_bytes long, n_words long, n_tokens long"))
