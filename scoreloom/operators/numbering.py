"""Dense row numbers in the order of the files, without sorting rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scoreloom.schema import ROW_ID
from scoreloom.session import settle, written

FILE, SPLIT, PLACE = "__file", "__split", "__place"


def file_places() -> list[Column]:
    """Where a scanned row lies: its file, the byte at which its split of the
    file begins, and a number that grows by one from row to row of the split.

    A split is read by one task from front to back, whatever else that task
    reads, so the three columns give one order under any packing and splitting
    of the files. To be selected from the scan itself, before any filter.
    """
    return [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(SPLIT),
            F.monotonically_increasing_id().alias(PLACE)]


def dense_numbers(df: DataFrame, part: Sequence[str] = (FILE, SPLIT), place: str = PLACE,
                  name: str = ROW_ID) -> DataFrame:
    """``df`` with ``name``, 0 to the number of rows less 1, in order of ``part``
    and ``place``, which are dropped.

    Rows of a part hold consecutive places, from any first one; no part column
    is NULL. The rows are written once, because their places may not come out
    alike a second time. Parts are counted where they lie, and the rows before
    a part are the running sum of the parts ahead of it: rows are neither
    sorted nor shuffled, and only the parts (splits of files) pass through one
    window. An empty table stays empty; equal rows get numbers of their own.
    """
    part = list(part)
    kept = written(df, "numbered")
    sizes = kept.groupBy(*part).agg(F.count(F.lit(1)).alias("__rows"), F.min(place).alias("__least"))
    ahead = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*part, (F.coalesce(F.sum("__rows").over(ahead), F.lit(0)) - F.col("__least")).alias("__shift"))
    return (kept.join(settle(first), part).withColumn(name, F.col("__shift") + F.col(place))
            .drop(*part, place, "__shift"))
