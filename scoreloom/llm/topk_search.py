"""Exact top-k search by term-at-a-time accumulation.

Every vector is a sparse row of whole-number weights, one per dimension
("term"). Candidates are packed into blocks that hold, term by term, the
weights of all members. A query walks its non-zero terms and scatters
``weight * postings`` into a dense array of scores, one slot per candidate;
the best k of each block are found by partition selection, and the short lists
of all blocks are merged by rank.

Queries and candidates meet block by block on an equi-join of block numbers,
so memory per task is one block of each, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from scoreloom.llm.runtime import spread

BLOCK = 4096            # candidates of a block
QUERY_BLOCK = 1024      # queries of a block
STEP = 64               # queries accumulated at a time
NEVER = -(1 << 63)      # score of a slot that is no candidate
WIDEST = 1 << 62        # components are smaller
_PACKED = "n int, dim int, ids binary, weights binary"


def _numbers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number rows of a list column and which of them take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)     # NULL becomes NaN
    dim = int(lengths.max()) if len(lengths) else 0
    row = np.repeat(np.arange(len(lengths)), lengths)
    ok = np.asarray(column.is_valid()) & (np.bincount(row, ~np.isfinite(values), len(lengths)) == 0)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    keep = np.isfinite(values)
    whole = np.floor(scale * values[keep])
    if np.abs(whole).max(initial=0) >= WIDEST:
        raise ValueError(f"a component times {scale} is {np.abs(whole).max():.3g}, beyond 62 bits")
    out[row[keep], place[keep]] = whole.astype(np.int64)
    return out, ok


def _pack(ids: np.ndarray, weights: np.ndarray) -> dict:
    return {"n": len(ids), "dim": weights.shape[1], "ids": ids.astype("<i8").tobytes(),
            "weights": np.ascontiguousarray(weights.T.astype("<i4" if np.abs(weights).max(initial=0) < 1 << 31 else "<i8")).tobytes()}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    n, dim = row["n"], row["dim"]
    width = 8 if len(row["weights"]) == 8 * n * dim and n * dim else 4
    return (np.frombuffer(row["ids"], "<i8"),
            np.frombuffer(row["weights"], f"<i{width}").reshape(dim, n))


def _packer(scale: float, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        schema = pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary())])

        def out():
            dim = max(r.shape[1] for r in rows)
            wide = np.concatenate([np.pad(r, ((0, 0), (0, dim - r.shape[1]))) for r in rows])
            return pa.RecordBatch.from_pylist([_pack(np.concatenate(ids), wide)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                values, ok = _numbers(part.column(1), scale)
                ok &= np.asarray(part.column(0).is_valid())
                ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False)[ok])
                rows.append(values[ok])
                held += int(ok.sum())
                if held >= size:
                    yield out()
                    ids, rows, held = [], [], 0
        if held:
            yield out()

    return pack


def scores_of(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Inner products of some query rows with a block, term at a time.

    ``postings`` holds one row of candidate weights per term; a missing term
    counts as zero. Sums that might pass 64 bits are formed in whole numbers of
    any size; a score that does pass them stops the job.
    """
    terms = min(queries.shape[1], postings.shape[0])
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(postings).max(initial=0)) * max(terms, 1)
    kind = np.int32 if largest < 1 << 31 else np.int64 if largest < 1 << 63 else object
    queries, postings = queries.astype(kind), postings.astype(kind, copy=False)
    scores = np.zeros((len(queries), postings.shape[1]), dtype=kind)
    for term in range(terms):
        rows = np.flatnonzero(queries[:, term])
        if len(rows) == len(queries):
            scores += queries[:, term, None] * postings[term]
        elif len(rows):
            scores[rows] += queries[rows, term, None] * postings[term]
    if kind is object and scores.size:
        if max(abs(scores.max()), abs(scores.min())) >= 1 << 63:
            raise ValueError("an inner product passes 64 bits")
        return scores.astype(np.int64)
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """The k best candidates of every row; ``ids`` ascend, so ties go to smaller ids."""
    n = len(ids)
    other = ids[None, :] != own[:, None]
    ranked = np.where(other, scores.astype(np.int64, copy=False), NEVER)
    take = other
    if n > k:
        last = np.partition(ranked, n - k, axis=1)[:, n - k, None]      # the k-th best score
        above, level = ranked > last, ranked == last
        room = k - np.count_nonzero(above, axis=1)[:, None]
        take = (above | (level & (np.cumsum(level, axis=1) <= room))) & other
    return np.nonzero(take)


def _searcher(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                ids, postings = _unpack({c: one[c] for c in ("n", "dim", "ids", "weights")})
                order = np.argsort(ids, kind="stable")
                ids, postings = ids[order], postings[:, order]
                own, weights = _unpack({c: one["q_" + c] for c in ("n", "dim", "ids", "weights")})
                weights = weights.T
                for at in range(0, len(own), STEP):
                    part = slice(at, at + STEP)
                    scores = scores_of(weights[part], postings)
                    r, c = best_of(scores, ids, own[part], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[part][r]), pa.array(ids[c]), pa.array(scores[r, c].astype(np.int64))], schema=schema)

    return search


def _query_packer(scale: float):
    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending")])
        values, ok = _numbers(group.column("vector").combine_chunks(), scale)
        ids = group.column("id").to_numpy()
        values, ids = values[ok], ids[ok]
        # A repeated id is one query: the smallest of its vectors.
        order = np.lexsort((*values.T[::-1], ids)) if len(ids) else np.zeros(0, np.int64)
        values, ids = values[order], ids[order]
        first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
        rows = [{"block": key[0].as_py(), **{"q_" + c: v for c, v in _pack(ids[first], values[first]).items()}}] if len(ids) else []
        return pa.Table.from_pylist(rows, schema=pa.schema([
            ("block", pa.int32()), ("q_n", pa.int32()), ("q_dim", pa.int32()), ("q_ids", pa.binary()), ("q_weights", pa.binary())]))

    return pack


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0,
               id_col: str = "vec_id", vector: str = "embedding",
               block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k candidates with the highest inner product for every query row.

    Weights are ``floor(scale * component)``. Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id, and a query with fewer than k
    candidates returns them all.

    Rows whose id or vector is NULL, or whose vector holds a NULL or non-finite
    component, take no part. Missing components of shorter vectors count as 0.
    Rows with a query's own id are not its candidates; repeated candidate rows
    count each, a repeated query id is asked once. Further columns are ignored.
    An empty table gives no rows. Weights beyond 62 bits, and scores beyond 64,
    stop the job: no whole number of the result could hold them.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"))
    asked = asked.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    n_blocks = max(1, -(-asked.count() // query_block))
    salts = 16
    queries = (asked.groupBy(spread(F.col("id"), n_blocks).alias("block"))
               .applyInArrow(_query_packer(scale), "block int, q_n int, q_dim int, q_ids binary, q_weights binary")
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    packed = (rows.mapInArrow(_packer(scale, block), _PACKED)
              .withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    met = packed.join(queries, ["block", "salt"]).select(
        "n", "dim", "ids", "weights", "q_n", "q_dim", "q_ids", "q_weights")
    lists = met.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
