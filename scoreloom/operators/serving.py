"""Models made elsewhere, applied to tables of features.

A model comes as bytes: a file that Spark can read (``model_file``) or a table
that ``store_model`` wrote. A loader turns the bytes into a function from a
matrix, one row of features each, to a matrix of logits. The bytes are
broadcast, at most ``MODEL_BYTES`` of them, and loaded once per Python worker;
rows reach the model in Arrow batches.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scoreloom.functions.probability import argmax, confidence

MODEL_BYTES = 512 << 20
BATCH = 1024

Model = Callable[[np.ndarray], np.ndarray]


def linear_bytes(weights: np.ndarray, bias: np.ndarray) -> bytes:
    """A linear model, classes x features and one bias per class, as an ``.npz`` file."""
    weights, bias = np.asarray(weights, np.float64), np.asarray(bias, np.float64)
    if weights.ndim != 2 or bias.shape != weights.shape[:1]:
        raise ValueError(f"weights {weights.shape} and bias {bias.shape} do not belong together")
    out = io.BytesIO()
    np.savez(out, weights=weights, bias=bias)
    return out.getvalue()


def linear_model(blob: bytes) -> Model:
    """The loader of ``linear_bytes``; nothing in the file is executed."""
    with np.load(io.BytesIO(blob), allow_pickle=False) as stored:
        weights, bias = stored["weights"], stored["bias"]
    return lambda rows: rows @ weights.T + bias


def _checked(size: int, name: str) -> None:
    if size > MODEL_BYTES:
        raise ValueError(f"{name} has {size} bytes, at most {MODEL_BYTES} are sent to the workers")


def store_model(spark: SparkSession, blob: bytes, path: str) -> None:
    """Write the bytes of a model as a table of one row."""
    _checked(len(blob), "the model")
    spark.createDataFrame([(len(blob), blob)], "length long, content binary").coalesce(1).write.parquet(path)


def _only(rows: DataFrame, path: str) -> bytes:
    # Sizes first, so that a table of many or large rows never reaches the driver.
    sizes = [r["length"] for r in rows.select("length").limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError(f"{path} must hold one model")
    _checked(sizes[0], path)
    return bytes(rows.select("content").first()["content"])


def stored_model(spark: SparkSession, path: str) -> bytes:
    """What ``store_model`` wrote."""
    return _only(spark.read.schema("length long, content binary").parquet(path), path)


def model_file(spark: SparkSession, path: str) -> bytes:
    """A model file from any file system that Spark reads."""
    return _only(spark.read.format("binaryFile").load(path), path)


def apply_model(df: DataFrame, blob: bytes, features: Column, width: int,
                load: Callable[[bytes], Model] = linear_model, batch: int = BATCH) -> DataFrame:
    """Add logits, p and confidence, as ``model.predict`` does. Narrow: no row moves.

    ``features`` is an array of ``width`` numbers. Where it is NULL, has another
    length or holds a NULL or NaN, the three columns are NULL and the row stays.
    Further columns pass through, those of the same three names are replaced;
    an empty table gives no rows. A model that does not return one row of
    logits per row of features stops the job.
    """
    _checked(len(blob), "the model")
    shared = df.sparkSession.sparkContext.broadcast(blob)

    def once():
        model = load(shared.value)

        def logits(rows: np.ndarray) -> np.ndarray:
            out = np.asarray(model(rows), dtype=np.float64)
            if out.ndim != 2 or len(out) != len(rows):
                raise ValueError(f"logits of shape {out.shape} for {len(rows)} rows")
            return out

        return logits

    scored = predict_batch_udf(once, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])
    given = features.cast("array<double>")
    usable = F.coalesce((F.size(given) == width) & F.forall(given, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    filled = F.when(usable, given).otherwise(F.array_repeat(F.lit(0.0), width))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("logits", "p", "confidence")]
    # The flag is taken before the model's column, so that replaced inputs never show.
    rows = df.select(*kept, usable.alias("__usable"), scored(filled).alias("__logits"))
    clean = rows.select(*kept, F.when(F.col("__usable"), F.col("__logits")).alias("logits"))
    return clean.select("*", argmax(F.col("logits")).alias("p"),
                        F.when(F.col("logits").isNotNull(), confidence(F.col("logits"))).alias("confidence"))


def centroid_model(df: DataFrame, label: str, features: str) -> tuple[bytes, list]:
    """A linear model that picks the class with the nearest mean, and its classes in order.

    Means come from one aggregation; rows without label, NULL features and NULL
    positions do not count. What reaches the driver is the model itself,
    classes x features, and is held against ``MODEL_BYTES`` before.
    """
    means = (df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(features).alias("at", "v"))
             .groupBy("label", "at").agg(F.avg(F.col("v").cast("double")).alias("mean")))
    kept = means.persist()
    try:
        _checked(8 * kept.count(), "the model")
        table = kept.orderBy("label", "at").toPandas()
    finally:
        kept.unpersist()
    wide = table.pivot(index="label", columns="at", values="mean")
    if wide.isna().to_numpy().any():
        raise ValueError("classes have features of different length")
    weights = wide.to_numpy(np.float64).reshape(len(wide), -1)
    return linear_bytes(weights, -0.5 * (weights * weights).sum(axis=1)), wide.index.tolist()
