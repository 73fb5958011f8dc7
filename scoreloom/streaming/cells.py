"""Confusion cells over a growing folder of scored rows.

Cells of separate files add up, so a stream needs no state: every micro-batch
is reduced to its own few cells, and a metric over everything seen so far is
a sum of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scoreloom.operators.metrics import confusion_cells, sum_cells


def read_scored(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def write_cells(scored: DataFrame, path: str, checkpoint: str, y: str = "y", p: str = "p",
                available_now: bool = True) -> StreamingQuery:
    """Reduce every micro-batch to cells and store them under its batch number.

    A batch that is run again after a failure replaces its own folder, so no
    row is counted twice.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        confusion_cells(batch, y, p).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = scored.select(y, p).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells over all batches stored so far."""
    return sum_cells(spark.read.parquet(path))
