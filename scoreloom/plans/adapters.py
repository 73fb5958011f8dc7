"""The shared test tables seen as graded answers, scored rows and model runs.

Each adapter comes with the SQL steps that define the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scoreloom.functions.hashing import MULTIPLIERS, draw
from scoreloom.functions.probability import argmax, confidence
from scoreloom.operators.labels import FOUR_GRADE_INDEX
from scoreloom.operators.lengths import length_columns, length_ratios
from scoreloom.session import gathered


# Columns the suite reads; given to the scans so that no file is opened to plan a query.
SCHEMAS = {
    "documents": "doc_id long, text string, source string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "orders": "o_orderkey long, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _grade() -> Column:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return (F.when(~good & toxic, "2").when(~good, "3").when(toxic, "4").otherwise("5"))


_GRADE_SQL = """CASE WHEN l.quality = 0 AND l.toxic = 1 THEN '2' WHEN l.quality = 0 THEN '3'
  WHEN l.toxic = 1 THEN '4' ELSE '5' END"""


def _with_reference(spark: SparkSession, sf_dir: str, df: DataFrame, key: Column,
                    **columns: Column) -> DataFrame:
    """Join a reference text to every row; no hint, its table may grow."""
    items = table(spark, sf_dir, "benchmark")
    count = items.agg(F.count("*")).scalar()
    slim = items.select("item_id", *[c.alias(n) for n, c in columns.items()])
    return df.withColumn("_item", key % count).join(slim, F.col("_item") == F.col("item_id")).drop(
        "_item", "item_id")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, question, reference_answer, student_answer, grade with full texts."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("question"),
        F.col("text").alias("student_answer"))
    return _with_reference(spark, sf_dir, documents.join(grades(spark, sf_dir), "row_id"),
                           F.col("row_id"), reference_answer=F.col("text"))


GRADED_SQL = ("graded", f"""
  SELECT d.doc_id AS row_id, d.source AS question, b.text AS reference_answer,
    d.text AS student_answer, {_GRADE_SQL} AS grade
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``graded`` without the grade: every document, labelled or not."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("question"), F.col("text").alias("student_answer"))
    return _with_reference(spark, sf_dir, documents, F.col("row_id"), reference_answer=F.col("text"))


def answer_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length columns of ``answers``, measured at the scans."""
    text = F.col("text")
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), length_columns(text, text)["answer_length"].alias("answer_length"))
    return length_ratios(_with_reference(
        spark, sf_dir, documents, F.col("row_id"), reference_length=length_columns(text, text)["reference_length"]))


ANSWERS_SQL = ("answers", """
  SELECT d.doc_id AS row_id, d.source AS question, b.text AS reference_answer, d.text AS student_answer
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, grade) alone; queries that need no text start here."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), _grade().alias("grade"))


def graded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length columns of ``graded``, measured at the scans.

    Only whole numbers and short strings pass through the joins.
    """
    text = F.col("text")
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        length_columns(text, text)["answer_length"].alias("answer_length"))
    joined = _with_reference(
        spark, sf_dir, documents.join(grades(spark, sf_dir), "row_id"), F.col("row_id"),
        reference_length=length_columns(text, text)["reference_length"])
    return length_ratios(joined)


def raw_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``graded`` before cleaning: gaps, missing-value spellings, mixed grade spellings."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("source") == "src3", "NA").when(F.col("source") != "src5", F.col("source"))
        .alias("question"), F.col("text").alias("student_answer"))
    labels = grades(spark, sf_dir).withColumnRenamed("grade", "_grade")
    spelled = (F.when(F.col("row_id") % 3 == 0, F.col("_grade"))
               .when(F.col("row_id") % 3 == 1, F.concat("_grade", F.lit(".0")))
               .otherwise(F.concat(F.lit(" "), "_grade")))
    joined = documents.join(labels, "row_id", "left").withColumn("grade", spelled).drop("_grade")
    return _with_reference(spark, sf_dir, joined, F.col("row_id"), reference_answer=F.col("text"))


def with_scores(df: DataFrame) -> DataFrame:
    """Add y, logits, p and confidence of a repeatable stand-in classifier.

    The logits follow from the grade and a hash of the row, so that SQL can
    recompute them; p and confidence are derived from the logits.
    """
    y = FOUR_GRADE_INDEX.encode(F.col("grade"))
    percent = draw(F.col("row_id")) % 100
    hop = F.when(percent < 70, 0).when(percent < 85, 1).when(percent < 95, 3).otherwise(2)
    margin = F.lit(0.5) + (draw(F.col("row_id"), word=1) % 100) / 25.0
    aimed = df.withColumns({"y": y, "_aim": (y + hop) % 4, "_margin": margin})
    logits = F.array(*[
        F.when(F.col("_aim") == c, F.col("_margin")).otherwise(F.abs(F.col("_aim") - c) * -0.25)
        for c in range(4)])
    return (aimed.withColumn("logits", logits)
            .withColumns({"p": argmax(F.col("logits")), "confidence": confidence(F.col("logits"))})
            .drop("_aim", "_margin"))


def graded_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(graded_lengths(spark, sf_dir))


SCORES_SQL = ("scores", """
  SELECT *, list_transform([0, 1, 2, 3], lambda c: CASE WHEN c = p THEN margin ELSE abs(p - c) * -0.25 END) AS logits
  FROM (SELECT *, (y + CASE WHEN h1 % 100 < 70 THEN 0 WHEN h1 % 100 < 85 THEN 1
        WHEN h1 % 100 < 95 THEN 3 ELSE 2 END) % 4 AS p, 0.5::DOUBLE + (h2 % 100)::DOUBLE / 25 AS margin
    FROM (SELECT row_id, grade, length(student_answer) AS answer_length,
        length(reference_answer) AS reference_length,
        length(student_answer)::DOUBLE / nullif(length(reference_answer), 0) AS length_ratio,
        grade::INT - 2 AS y, ('0x' || substr(md5(row_id::VARCHAR), 1, 8))::BIGINT AS h1,
        ('0x' || substr(md5(row_id::VARCHAR), 9, 8))::BIGINT AS h2 FROM graded))""")

SCORED_SQL = ("scored", """
  SELECT *, (p + 2)::VARCHAR AS predicted_grade,
    1.0 / list_sum(list_transform(logits, lambda v: exp(v - list_max(logits)))) AS confidence
  FROM scores""")

GRADED_SCORED = (GRADED_SQL, SCORES_SQL, SCORED_SQL)


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as graded and scored answers: the large table of the suite.

    ``row_id`` names the line of an order; some lines occur more than once.
    """
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 1048576 + l_linenumber AS row_id",
        "CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 30 THEN 2 ELSE 3 END AS y",
        "(l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 100 AS h",
        "CAST(floor(l_extendedprice / 100) AS int) AS answer_length",
        "CAST(l_partkey % 900 + 20 AS int) AS reference_length")
    return length_ratios(rows.selectExpr(
        "*", "(y + CASE WHEN h < 70 THEN 0 WHEN h < 85 THEN 1 WHEN h < 95 THEN 3 ELSE 2 END) % 4 AS p",
        "CAST(y + 2 AS string) AS grade", "0.4D + (h % 60) / 100.0D AS confidence"))


BULK_SQL = ("bulk", """
  SELECT *, (y + CASE WHEN h < 70 THEN 0 WHEN h < 85 THEN 1 WHEN h < 95 THEN 3 ELSE 2 END) % 4 AS p,
    (y + 2)::VARCHAR AS grade, 0.4::DOUBLE + (h % 60)::DOUBLE / 100 AS confidence,
    answer_length::DOUBLE / nullif(reference_length, 0) AS length_ratio
  FROM (SELECT l_orderkey * 1048576 + l_linenumber AS row_id,
    (CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 30 THEN 2 ELSE 3 END)::INT AS y,
    (l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 100 AS h,
    floor(l_extendedprice / 100)::INT AS answer_length, (l_partkey % 900 + 20)::INT AS reference_length
    FROM lineitem)""")


def order_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, grade): orders by the first sign of their priority; the ids are unique."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row_id", "substring(o_orderpriority, 1, 1) AS grade")


ORDERS_SQL = ("order_grades", """
  SELECT o_orderkey AS row_id, left(o_orderpriority, 1) AS grade FROM orders""")


def binary_prediction() -> Column:
    """Two-class stand-in prediction on ``bulk`` rows."""
    p, h = F.col("p"), F.col("h")
    return F.when((p == 3) | ((p == 2) & (h % 2 == 0)), 1).otherwise(0)


BINARY_SQL = "CASE WHEN p = 3 OR (p = 2 AND h % 2 = 0) THEN 1 ELSE 0 END"

# Versions of a model and the share of rows (in percent) each gets right.
VERSIONS = (("baseline", 30), ("v1", 62), ("v2", 63), ("v3", 80), ("v4", 83))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, run_order, y, p, n): cells of five model versions on ``bulk``.

    The versions differ only by (y, h), so the rows are counted once and the
    fan-out to versions happens on at most 400 counts.
    """
    counts = gathered(bulk(spark, sf_dir).groupBy("y", "h").agg(F.count("*").alias("n")))
    wrong = (F.col("y") + 1 + F.col("h") % 3) % 4
    versions = F.array(*[
        F.struct(F.lit(name).alias("run"), F.lit(i).alias("run_order"),
                 F.when(F.col("h") < keep, F.col("y")).otherwise(wrong).cast("int").alias("p"))
        for i, (name, keep) in enumerate(VERSIONS)])
    return (counts.select("y", "n", F.inline(versions))
            .groupBy("run", "run_order", "y", "p").agg(F.sum("n").alias("n")))


_VERSION_ROWS = ", ".join(f"('{name}', {i}, {keep})" for i, (name, keep) in enumerate(VERSIONS))
RUN_ROWS_SQL = ("run_rows", f"""
  SELECT v.run, v.run_order, b.y, (CASE WHEN b.h < v.keep THEN b.y ELSE (b.y + 1 + b.h % 3) % 4 END)::INT AS p
  FROM bulk b, (VALUES {_VERSION_ROWS}) v(run, run_order, keep)""")
RUNS_SQL = ("runs", """
  SELECT run, run_order, y, p, count(*) AS n FROM run_rows GROUP BY ALL""")
RUNS = (BULK_SQL, RUN_ROWS_SQL, RUNS_SQL)

CLASSES = 10


def logit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y, logits: every embedding folded to one score per class.

    Class c gets the sum of all numbers whose position leaves c modulo the classes.
    """
    def score(c: Column) -> Column:
        return F.aggregate(F.filter("embedding", lambda v, i: i % CLASSES == c), F.lit(0.0),
                           lambda total, v: total + v.cast("double"))

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("y"),
        F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), score).alias("logits"))


LOGITS_SQL = ("logit_rows", f"""
  SELECT vec_id AS row_id, label AS y, [list_sum([v::DOUBLE FOR v, i IN embedding IF (i - 1) % {CLASSES} = c]) FOR c IN range({CLASSES})] AS logits
  FROM embeddings""")


def mix_sql(key: str, seed: int) -> str:
    """SQL of ``mix``."""
    x = f"(xor(xor({key}, {key} >> 32), {seed}) & 4294967295)"
    for multiplier, shift in zip(MULTIPLIERS, (16, 15)):
        x = f"((xor({x}, {x} >> {shift}) * {multiplier}) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


EPOCHS = 8


def epoch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, y, logits): the logit rows in three runs at eight sharpness levels."""
    rows = logit_rows(spark, sf_dir).select(
        F.concat(F.lit("r"), (F.col("row_id") % 3).cast("string")).alias("run"), "y",
        F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "logits")
    lift = F.lit(0.25) - F.abs(F.col("epoch") - 5) * 0.02
    lifted = F.transform("logits", lambda v, i: (
        (v + F.when(i == F.col("y"), lift).otherwise(0.0)) * F.col("epoch") * 3))
    return rows.withColumn("logits", lifted).withColumn("p", argmax(F.col("logits")))


EPOCH_ROWS_SQL = ("epoch_rows", f"""
  SELECT *, list_position(logits, list_max(logits)) - 1 AS p FROM (
    SELECT 'r' || (row_id % 3)::VARCHAR AS run, e.epoch::INT AS epoch, y,
      list_transform(logits, lambda v, i: (v + CASE WHEN i - 1 = y THEN 0.25::DOUBLE - abs(e.epoch - 5) * 0.02 ELSE 0 END) * e.epoch * 3) AS logits
    FROM logit_rows, range(1, {EPOCHS + 1}) e(epoch))""")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, the assistant's next turn as the answer.

    The turns meet by an equi-join on (conversation, turn), so even a very
    long conversation is spread over all tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("student_answer"))
    pairs = asked.join(answered, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1048576 + F.col("turn")).alias("row_id"), "question", "student_answer")
    return _with_reference(spark, sf_dir, pairs, F.col("row_id"), reference_answer=F.col("text"))


TURNS_SQL = ("turn_pairs", """
  SELECT u.conv_id * 1048576 + u.turn AS row_id, u.text AS question, a.text AS student_answer,
    b.text AS reference_answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  JOIN benchmark b ON b.item_id = (u.conv_id * 1048576 + u.turn) % (SELECT count(*) FROM benchmark)
  WHERE u.role = 'user' AND a.role = 'assistant'""")
