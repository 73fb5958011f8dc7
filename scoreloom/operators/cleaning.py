"""Dropping incomplete rows, row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scoreloom.functions.grades import normalise_grade, null_if_missing
from scoreloom.schema import GRADE, REQUIRED_COLUMNS, ROW_ID


def drop_incomplete(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Keep rows whose required fields are all present; grades get one spelling.

    A required column that does not exist is an error, as the analysis of a
    table without it would be meaningless. Narrow: no shuffle, and the plain
    null tests reach the file scan.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing: {absent}")
    present = df.na.drop(how="any", subset=list(required))
    cleaned = present.withColumns({
        c: normalise_grade(F.col(c)) if c == GRADE else null_if_missing(F.col(c))
        for c in required})
    return cleaned.na.drop(how="any", subset=list(required))


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """A unique row number for sources that carry no key of their own.

    The number is unique and costs no shuffle; it is not dense. Write the table
    once after adding it if later jobs must agree on the numbers.
    """
    return df.withColumn(name, F.monotonically_increasing_id())
