"""Session settings and the small set of helpers that touch the session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only after it has been shown to hold no more rows and
# bytes (written as text) than this.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 8 << 20


def build_session(app: str = "scoreloom", cpus: str | int = "*",
                  shuffle_partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the session's ``spark.checkpoint.dir``, or the folder given to
    ``setCheckpointDir``. Without either the job stops: a folder of one machine
    would lose tables with an executor. Only a session whose executors are
    threads of the driver takes a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scoreloom-"))
    if root is None:
        return context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return os.path.join(checkpoint_root(spark), "scoreloom", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, into the shared folder, and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """Put an aggregate that is known to have few rows into one partition.

    Only for results bounded by closed sets: classes, bins, runs. Whatever is
    computed from them afterwards then needs no further shuffle. A column of
    ids is no label; counts of any column go through ``settle``.
    """
    return df.coalesce(1)


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Evaluate a derived side once and mark it for broadcast if it is small.

    The side is computed once, in as many tasks as it has partitions, and
    measured in rows and bytes. Within both bounds it becomes a literal
    relation with a broadcast hint. A larger side is written to the checkpoint
    folder and returned without a hint, so that the join is planned as a
    shuffle join (with the skew handling of AQE).
    """
    kept = df.persist()
    try:
        size = kept.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first() if df.columns else (0, 0)
        if size[0] <= max_rows and (size[1] or 0) <= max_bytes:
            return F.broadcast(df.sparkSession.createDataFrame(kept.toArrow(), df.schema))
        checkpoint_root(df.sparkSession)
        return kept.checkpoint()
    finally:
        kept.unpersist()
