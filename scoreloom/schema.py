"""Column names, closed value sets and schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

ROW_ID = "row_id"
QUESTION = "question"
REFERENCE = "reference_answer"
STUDENT = "student_answer"
GRADE = "grade"

REQUIRED_COLUMNS = (QUESTION, REFERENCE, STUDENT, GRADE)

# Headers of graded-answer files, in file order.
SOURCE_HEADERS = {
    "Вопрос": QUESTION,
    "Эталонный ответ преподавателя": REFERENCE,
    "Ответ студента": STUDENT,
    "Оценка": GRADE,
}

# The four grades of the full scale.
FOUR_GRADES = ("2", "3", "4", "5")

# Field contents that count as missing when a file is read
# (the default missing-value spellings of pandas).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Column types that count things.
WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

GRADED_SCHEMA = T.StructType([
    T.StructField(ROW_ID, T.LongType()),
    T.StructField(QUESTION, T.StringType()),
    T.StructField(REFERENCE, T.StringType()),
    T.StructField(STUDENT, T.StringType()),
    T.StructField(GRADE, T.StringType()),
])

CELLS_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("run_order", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("p", T.IntegerType()),
    T.StructField("n", T.LongType()),
])
