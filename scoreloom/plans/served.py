"""A stored model applied to the vectors of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import metrics, serving
from scoreloom.plans.registry import query, steps
from scoreloom.session import scratch_path

WIDTH = 64

# The same model in SQL: class means, x.w - w.w / 2 per row and class, the first of the best classes.
_SERVED = (
    ("cells", f"SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, {WIDTH + 1}) r(i)"),
    ("means", "SELECT label AS class, i, avg(x) AS w FROM cells GROUP BY ALL"),
    ("logits", "SELECT vec_id, label, class, sum(x * w) - sum(w * w) / 2 AS logit FROM cells JOIN means USING (i) GROUP BY ALL"),
    ("ranked", """SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class) AS place,
      dense_rank() OVER (ORDER BY class) - 1 AS p, max(logit) OVER (PARTITION BY vec_id) AS top FROM logits"""),
    ("served", """SELECT vec_id, label, max(logit) AS logit, min(p) FILTER (place = 1) AS p, 1 / sum(exp(logit - top)) AS confidence
      FROM ranked GROUP BY vec_id, label"""))


def _served(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    blob, classes = serving.centroid_model(rows, "label", "embedding")
    path = scratch_path(spark, "model")
    serving.store_model(spark, blob, path)
    return serving.apply_model(rows, serving.stored_model(spark, path), F.col("embedding"), WIDTH), classes


@query("served_model", steps(*_SERVED, """
  SELECT vec_id, p::INT AS p, round(logit, 5) AS logit, round(confidence, 5) AS confidence FROM served"""))
def _(spark, sf_dir):
    scored, _ = _served(spark, sf_dir)
    return scored.select("vec_id", "p", F.round(F.array_max("logits"), 5).alias("logit"), F.round("confidence", 5).alias("confidence"))


@query("served_matrix", steps(*_SERVED, """
  SELECT (SELECT count(DISTINCT class) FROM means WHERE class < label)::INT AS y, p::INT AS p, count(*) AS n FROM served GROUP BY ALL"""))
def _(spark, sf_dir):
    scored, classes = _served(spark, sf_dir)
    number = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))]) if classes else F.lit(None)
    return metrics.confusion_cells(scored.withColumn("y", number[F.col("label")])).select("y", "p", "n")
