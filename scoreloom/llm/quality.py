"""Quality classifier: naive Bayes features under a support vector machine.

A text is the set of its n-grams (words and runs of signs, one and two in a
row, and the forms of one to three in a row: capitals, digits, signs), hashed
to ``1 << BITS`` places. Each indicator is scaled by the log-count ratio of the
two classes, rows are scaled to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent.

The fit uses at most ``SAMPLE`` labelled rows, chosen by a hash of the id. They
are dealt to ``SHARDS`` tasks; each fits its own model and the mean of all is
applied to every document. Margins of rows under the models of other shards
give the sigmoid that turns a margin into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scoreloom.functions.hashing import draw
from scoreloom.llm.runtime import stored
from scoreloom.llm.textvec import ODD, U64, flat, hash_runs, lowered, mix, portions

BITS = 18
SAMPLE = 12_000
SHARDS = 6
EPOCHS = 20
COST = 1.0
SMOOTH = 1.0
THRESHOLD = 0.3
SEED = 42

# Classes of bytes: 0 white space, 1 letters, digits and all beyond ASCII, 2 other signs.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CAPITAL = np.zeros(256, dtype=np.int32)
_CAPITAL[0x41:0x5B] = 1
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[0x30:0x3A] = 1


def _tokens(raw: np.ndarray, starts: np.ndarray):
    """Runs of one byte class: hash of the content, hash of the form, text."""
    kind = np.concatenate((np.zeros(1, np.uint8), _CLASS[raw], np.zeros(1, np.uint8)))
    change = kind[1:] != kind[:-1]
    cuts = starts[1:-1]
    change[cuts[(cuts > 0) & (cuts < len(raw))]] = True
    at = np.flatnonzero(change)
    begin, end = at[:-1], at[1:]
    used = kind[begin + 1] > 0
    begin, end = begin[used], end[used]
    kind = kind[begin + 1]
    content = hash_runs(lowered(raw), begin, end)
    capitals = np.concatenate(([0], np.cumsum(_CAPITAL[raw])))
    digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
    size, many = end - begin, capitals[end] - capitals[begin]
    form = np.where(digits[end] > digits[begin], 4, np.where(many == 0, 0, np.where((many == size) & (size > 1), 2, np.where((many == 1) & (_CAPITAL[raw[begin]] == 1), 1, 3))))
    form = np.where(kind == 2, content, mix(form.astype(U64) + U64(ODD[3])))
    return content, form, np.searchsorted(starts, begin, side="right") - 1


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place) of the n-grams of a batch, sorted."""
    raw, starts = flat(batch.column("text"))
    content, form, text = _tokens(raw, starts)
    found = []
    for stream, (values, longest) in enumerate(((content, 2), (form, 3))):
        h = np.zeros(len(values), dtype=U64)
        for n in range(1, longest + 1):
            h = h[:len(values) - n + 1] * U64(ODD[0]) + values[n - 1:] * U64(ODD[4])
            same = text[:len(h)] == text[n - 1:] if len(h) else np.zeros(0, bool)
            place = mix(h[same] + U64(17 * stream + n)) >> U64(64 - BITS)
            found.append(text[:len(h)][same].astype(np.int64) << BITS | place.astype(np.int64))
    keys = np.sort(np.concatenate(found))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32)


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        text, place = features(batch)
        ends = np.cumsum(np.bincount(text, minlength=batch.num_rows))
        first = np.concatenate(([0], ends[:-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("label"), pa.ListArray.from_arrays(pa.array(np.concatenate((first, ends[-1:])).astype(np.int32)), pa.array(place))],
            names=["shard", "label", "places"])


def log_ratios(rows: DataFrame) -> np.ndarray:
    """Log of the share of a place in class 1 over its share in class 0."""
    counts = (rows.select("label", F.explode("places").alias("place")).groupBy("place")
              .agg(F.sum("label").alias("one"), F.count(F.lit(1)).alias("n")).toPandas())    # 1 << BITS rows at most
    one, zero = np.full(1 << BITS, SMOOTH), np.full(1 << BITS, SMOOTH)
    place = counts["place"].to_numpy(dtype=np.int64)
    one[place] += counts["one"].to_numpy(dtype=np.float64)
    zero[place] += (counts["n"] - counts["one"]).to_numpy(dtype=np.float64)
    return np.log(one / one.sum()) - np.log(zero / zero.sum())


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED):
    """Weights over places (already times the ratio) and a bias: hinge loss with
    an L2 penalty, solved in the dual one row at a time. Row i is the ratios of
    its places, scaled to unit length, and a constant 1 for the bias."""
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    y = np.where(labels > 0, 1.0, -1.0)
    # Rare classes weigh as much as common ones.
    top = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    values = [ratios[r] / max(math.sqrt(float(ratios[r] @ ratios[r])), 1e-9) for r in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), top[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratios, bias


def _fitter(ratios):
    def fit(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lists = group.column("places").combine_chunks()
        rows = [np.asarray(lists[i].values) for i in range(len(lists))]
        w, bias = dual_coordinate_descent(rows, group.column("label").to_numpy(), ratios.value)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([w.astype("<f4").tobytes()], pa.binary()),
                         "bias": pa.array([bias], pa.float64()), "n": pa.array([len(rows)], pa.int64())})

    return fit


def _margins(text: np.ndarray, place: np.ndarray, n: int, weights: np.ndarray, bias: float, ratios: np.ndarray) -> np.ndarray:
    total = np.bincount(text, weights[place], n)
    length = np.sqrt(np.bincount(text, ratios[place] ** 2, n))
    return total / np.maximum(length, 1e-9) + bias


def _cross_scorer(models, ratios):
    """Margin of every sample row under the mean model of the other shards."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column("places"), np.zeros(batch.num_rows)
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                weights, bias = models.value[shard]
                place = np.asarray(lists[i].values)
                out[i] = _margins(np.zeros(len(place), np.int64), place, 1, weights, bias, ratios.value)[0]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out)], names=["label", "margin"])

    return score


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of P(1) = sigmoid(slope * margin + offset), by Newton steps."""
    x = np.stack((margins, np.ones(len(margins))), axis=1)
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, gradient)
    return float(max(theta[0], 0.1)), float(theta[1])


def _scorer(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, ratios, slope, offset = model.value
        for batch in portions(batches):
            text, place = features(batch)
            z = np.clip(slope * _margins(text, place, batch.num_rows, weights, bias, ratios) + offset, -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], schema=schema)

    return score


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, shards: int = SHARDS):
    """The model (weights, bias, ratios, slope, offset) of the labelled rows that are not held out."""
    spark = docs.sparkSession
    # One label per id: contradicting labels of an id count as the lower one.
    named = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label")))
    chosen = named.withColumn("place", draw(F.col("doc_id"), F.lit(SEED))).orderBy("place", "doc_id").limit(sample)
    chosen = stored(chosen.select("doc_id", "label", F.pmod("place", F.lit(shards)).cast("int").alias("shard")), "labels")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id")         # at most `sample` narrow rows
            .select("shard", "label", "text").mapInArrow(_featuriser, "shard int, label int, places array<int>"))
    rows = stored(rows, "features")
    ratios = log_ratios(rows)
    shared = spark.sparkContext.broadcast(ratios)
    fits = rows.groupBy("shard").applyInArrow(_fitter(shared), "shard int, weights binary, bias double, n long").collect()    # `shards` rows
    if not fits:
        return np.zeros(1 << BITS), 0.0, ratios, 1.0, 0.0
    each = {r["shard"]: (np.frombuffer(r["weights"], "<f4").astype(np.float64), r["bias"]) for r in fits}

    def mean(of):
        of = list(of) or list(each)
        return sum(each[s][0] for s in of) / len(of), sum(each[s][1] for s in of) / len(of)

    others = spark.sparkContext.broadcast({s: tuple(mean(o for o in each if o != s)) for s in each})
    margins = rows.mapInArrow(_cross_scorer(others, shared), "label int, margin double").toPandas()       # `sample` rows
    slope, offset = sigmoid_fit(margins["margin"].to_numpy(), margins["label"].to_numpy(dtype=np.float64))
    return (*mean(each), ratios, slope, offset)


def score_quality(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every document.

    Scores depend on the text alone. NULL and empty texts have no n-grams and
    get the score of the bias. Repeated rows and NULL ids are scored each, an
    empty table gives no rows, further columns are ignored. Without labelled
    rows every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .mapInArrow(_scorer(shared), "doc_id long, score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, ratios, slope, offset = shared.value
        for batch in portions(batches):
            text, place = features(batch)
            z = np.clip(slope * _margins(text, place, batch.num_rows, weights, bias, ratios) + offset, -30, 30)
            yield batch.filter(pa.array(1 / (1 + np.exp(-z)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
