"""Stored quantile sketches held against the rows they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import sketches
from scoreloom.operators.lengths import QUARTILES
from scoreloom.plans.adapters import BULK_SQL, bulk
from scoreloom.plans.registry import query, steps
from scoreloom.schema import GRADE
from scoreloom.session import settle, written

PARTS = 16


@query("bulk_length_sketch", steps(BULK_SQL, f"""
  SELECT grade, q, count(*) AS n, true AS within FROM bulk, (VALUES {", ".join(f"({q}::DOUBLE)" for q in QUARTILES)}) v(q)
  WHERE answer_length IS NOT NULL GROUP BY grade, q"""))
def _(spark, sf_dir):
    """Sketches per part, stored and merged; the rank of every estimate, counted in the rows, is within the bound."""
    rows = bulk(spark, sf_dir).where(F.col("answer_length").isNotNull())
    parts = written(sketches.sketch_parts(rows.withColumn("part", F.pmod(F.hash("row_id"), F.lit(PARTS))), "answer_length", [GRADE], "part"),
                    "length-sketches")
    found = settle(sketches.sketched_quantiles(sketches.merged(parts, [GRADE]), [GRADE], QUARTILES).select(
        GRADE, F.col("n").alias("sketched"), "quantiles"))
    v, at = F.col("answer_length").cast("double"), range(len(QUARTILES))
    counted = rows.select(GRADE, "answer_length").join(found, GRADE).groupBy(GRADE).agg(
        F.count("*").alias("n"), F.max("sketched").alias("sketched"),
        *[F.count_if(v < F.col("quantiles")[i]).alias(f"below_{i}") for i in at],
        *[F.count_if(v <= F.col("quantiles")[i]).alias(f"upto_{i}") for i in at])

    def judged(i, q):
        low, high = F.col("n") * (q - sketches.RANK_ERROR), F.col("n") * (q + sketches.RANK_ERROR)
        return F.struct(F.lit(q).alias("q"), ((F.col("sketched") == F.col("n")) & (F.col(f"below_{i}") <= high)
                                              & (F.col(f"upto_{i}") >= low)).alias("within"))

    return counted.select(GRADE, "n", F.inline(F.array(*[judged(i, q) for i, q in enumerate(QUARTILES)])))
