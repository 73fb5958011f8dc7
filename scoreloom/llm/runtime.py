"""Scratch tables and row identity shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scoreloom.session import checkpoint_root


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: it is computed
    once, and a lost executor costs no more than reading the files again."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, the size from which numbers of buckets follow."""
    return docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def parts_for(amount: int, each: int, least: int = 12) -> int:
    """How many buckets of about ``each`` hold ``amount``."""
    return max(least, -(-amount // each))


def spread(column: Column, n: int) -> Column:
    """A bucket number in 0 .. n-1 from the hash of a column."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


FILTER_WORDS = 1 << 18      # 64-bit words of a broadcast filter, at most


def text_tag(text: Column) -> Column:
    """A hash that, with the doc_id, names the content of a row."""
    return F.xxhash64(text.cast("string"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows named in ``gone`` (doc_id, tag; see ``text_tag``).

    A filter of one bit per tag, of bounded size, lets most rows that stay pass
    where they are read; the others meet ``gone`` in an exact anti-join, so
    that texts that stay are hardly shuffled.
    """
    flagged, gone = _flagged(docs, gone)
    tagged = flagged.where("__possible")
    checked = tagged.join(gone, tagged["doc_id"].eqNullSafe(gone["doc_id"]) & (tagged["__tag"] == gone["tag"]), "left_anti")
    return flagged.where("NOT __possible").unionByName(checked).select(*docs.columns)


def _flagged(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = stored(gone.select("doc_id", "tag").distinct(), "gone")
    n = gone.count()
    words = 64
    while words < FILTER_WORDS and words * 64 < 16 * n:
        words *= 2

    def place(tag):
        return F.pmod(tag, F.lit(words * 64))

    def bit(tag):
        return F.call_function("shiftleft", F.lit(1).cast("long"), (place(tag) % 64).cast("int"))

    marks = (gone.select((place(F.col("tag")) / 64).cast("int").alias("__word"), bit(F.col("tag")).alias("bit"))
             .groupBy("__word").agg(F.bit_or("bit").alias("__bits")))
    marks = stored(marks, "marks")
    tagged = docs.withColumn("__tag", text_tag(F.col("text"))).withColumn("__word", (place(F.col("__tag")) / 64).cast("int"))
    flagged = tagged.join(F.broadcast(marks), "__word", "left")      # FILTER_WORDS rows at most
    return flagged.withColumn("__possible", F.coalesce(F.col("__bits").bitwiseAND(bit(F.col("__tag"))) != 0, F.lit(False))), gone


def once(docs: DataFrame, copies: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows in ``gone``, with rows named in ``copies`` kept once."""
    named = copies.select("doc_id", "tag").unionByName(gone.select("doc_id", "tag"))
    rest = without(docs, named)
    flagged, copies = _flagged(docs, copies)
    tagged = flagged.where("__possible")
    kept = tagged.join(copies, tagged["doc_id"].eqNullSafe(copies["doc_id"]) & (tagged["__tag"] == copies["tag"]), "left_semi")
    return rest.unionByName(kept.dropDuplicates(["doc_id", "__tag"]).select(*docs.columns))
