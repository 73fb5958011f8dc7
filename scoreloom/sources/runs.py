"""Model runs given as confusion matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from scoreloom.schema import CELLS_SCHEMA


def runs_from_matrices(spark: SparkSession,
                       matrices: Mapping[str, Sequence[Sequence[int]]]) -> DataFrame:
    """Long-form cells of runs in the given order; rows are true labels."""
    rows = [(run, order, y, p, int(n))
            for order, (run, matrix) in enumerate(matrices.items())
            for y, line in enumerate(matrix) for p, n in enumerate(line)]
    return spark.createDataFrame(rows, CELLS_SCHEMA)
