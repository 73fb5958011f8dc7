"""Row-level outputs: sample ledger, shortest and longest answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scoreloom.functions.text import preview
from scoreloom.operators.labels import ClassIndex
from scoreloom.schema import GRADE, ROW_ID, STUDENT


def with_verdict(df: DataFrame, index: ClassIndex, p: str = "p", grade: str = GRADE) -> DataFrame:
    """Add the predicted grade by name and whether it is right."""
    predicted = index.decode(F.col(p))
    return df.withColumns({"predicted_grade": predicted, "is_correct": predicted == F.col(grade)})


def sample_ledger(df: DataFrame, row_id: str = ROW_ID, grade: str = GRADE) -> DataFrame:
    """(row_id, true_grade, predicted_grade, is_correct), keyed by the row itself."""
    return df.select(row_id, F.col(grade).alias("true_grade"), "predicted_grade", "is_correct")


def with_preview(df: DataFrame, student: str = STUDENT) -> DataFrame:
    return df.withColumn("answer_preview", preview(F.col(student)))


def extreme_answers(df: DataFrame, longest: bool, count: int = 5, row_id: str = ROW_ID,
                    length: str = "answer_length") -> DataFrame:
    """The shortest or longest answers; equal lengths go by row id.

    Each task keeps ``count`` rows. Hand it the preview and not the whole text.
    """
    first = F.desc(length) if longest else F.asc(length)
    return df.orderBy(first, F.asc(row_id)).limit(count)
