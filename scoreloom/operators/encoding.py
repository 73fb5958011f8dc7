"""Vocabulary and fixed-length encoding of text pairs."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W
from pyspark.sql.functions import arrow_udf

from scoreloom.functions.text import tokens
from scoreloom.schema import ROW_ID

PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_TOKEN_ID = 4
MAX_LENGTH = 512
# Largest vocabulary that may travel to the executors as one object.
LOOKUP_TOKENS = 200_000


def token_counts(df: DataFrame, *texts: str) -> DataFrame:
    """(token, n) over the given text columns; frequent tokens combine on the map side."""
    words = F.flatten(F.array(*[tokens(F.col(t)) for t in texts]))
    return df.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def sum_counts(*counts: DataFrame) -> DataFrame:
    """Token counts of several tables added up; each text is counted where it is stored."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """(token_id, token, n) of the ``size`` most frequent tokens, ties by token.

    Every task keeps its best ``size`` tokens and only those meet.
    """
    order = (F.desc("n"), F.asc("token"))
    position = F.row_number().over(W.orderBy(*order))
    return counts.orderBy(*order).limit(size).select(
        (position + (FIRST_TOKEN_ID - 1)).alias("token_id"), "token", "n")


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """Keep a vocabulary next to the model that was trained with it."""
    vocab.select("token_id", "token", "n").write.mode("errorifexists").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token_id int, token string, n long").parquet(path)


@dataclass(frozen=True)
class TokenIds:
    """Token list held on the driver; ids are its positions plus the offset."""

    words: tuple[str, ...]

    def lookup(self, toks: Column) -> Column:
        """Array of ids for an array of tokens; unknown tokens get UNK."""
        words = self.words
        table = []

        @arrow_udf("array<int>")
        def ids(column: pa.Array) -> pa.Array:
            if not table:
                table.append(pa.array(words, pa.string()))
            found = pc.index_in(column.flatten().cast(pa.string()), value_set=table[0])
            flat = pc.fill_null(pc.add(found, FIRST_TOKEN_ID), UNK).cast(pa.int32())
            sizes = pc.fill_null(pc.list_value_length(column), 0)
            ends = pc.cumulative_sum(sizes.cast(pa.int32()))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
            return pa.ListArray.from_arrays(offsets, flat, mask=pc.is_null(column))

        return ids(toks)


def fit_token_ids(vocab: DataFrame) -> TokenIds | DataFrame:
    """A vocabulary ready for ``pair_encode``: a list on the driver if it has at
    most LOOKUP_TOKENS tokens, otherwise the table itself, for a join."""
    rows = vocab.select("token_id", "token").limit(LOOKUP_TOKENS + 1).collect()
    if len(rows) > LOOKUP_TOKENS:
        return vocab
    return TokenIds(tuple(r["token"] for r in sorted(rows, key=lambda r: r["token_id"])))


def joined_ids(cut: DataFrame, vocab: DataFrame, row_id: str) -> DataFrame:
    """Add ``_ids`` by a join of single tokens, for vocabularies of any size.

    Rows regroup by their id; a row has at most the length limit of tokens.
    """
    both = F.concat("tokens_a", "tokens_b")
    single = cut.select(row_id, F.posexplode(both).alias("_at", "token"))
    coded = (single.join(vocab.select("token", "token_id"), "token", "left")
             .groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct(
                 "_at", F.coalesce("token_id", F.lit(UNK)).cast("int").alias("id")))).alias("_found")))
    ids = F.transform("_found", lambda t: t["id"])
    empty = F.when(~F.col("overflow"), F.array().cast("array<int>"))
    return cut.join(coded, row_id, "left").withColumn("_ids", F.coalesce(ids, empty)).drop("_found")


def hashed_ids(toks: Column, buckets: int) -> Column:
    """Ids without a vocabulary, by hash, entirely inside the JVM."""
    def one(t: Column) -> Column:
        prefix = F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint")
        return (prefix % buckets + FIRST_TOKEN_ID).cast("int")

    return F.transform(toks, one)


def pair_tokens(df: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Tokens of both texts cut to the length limit, second text only.

    Three places go to the special ids. A row whose first text alone exceeds
    the rest cannot be encoded: it is kept, flagged ``overflow``, with NULL
    arrays.
    """
    sized = (df.withColumns({"_a": tokens(F.col("text_a")), "_b": tokens(F.col("text_b"))})
             .withColumn("_room", F.lit(max_length - 3) - F.size("_a")))
    fits = F.col("_room") >= 0
    return sized.withColumns({
        "overflow": ~fits,
        "tokens_a": F.when(fits, F.col("_a")),
        "tokens_b": F.when(fits, F.slice("_b", F.lit(1), F.greatest("_room", F.lit(0)))),
    }).drop("_a", "_b", "_room")


def pair_encode(df: DataFrame, ids: TokenIds | DataFrame | int, max_length: int = MAX_LENGTH,
                pad: bool = True, row_id: str = ROW_ID) -> DataFrame:
    """Add input_ids, token_type_ids and attention_mask for text_a and text_b.

    ``ids`` is a fitted vocabulary (a list, or a table that is joined by token;
    then ``row_id`` names a unique key), or a bucket count for hashed ids. Only
    tokens that survive the cut are looked up. Other columns, such as the
    label, stay on the row.
    With ``pad=False`` the arrays keep their own length, which is the form to
    store; padding is then the last projection before use.
    """
    cut = pair_tokens(df, max_length)
    both = F.concat("tokens_a", "tokens_b")
    if isinstance(ids, DataFrame):
        coded = joined_ids(cut, ids, row_id)
    else:
        coded = cut.withColumn("_ids", ids.lookup(both) if isinstance(ids, TokenIds) else hashed_ids(both, ids))
    coded = coded.withColumns({
        "n_a": F.size("tokens_a"), "n_b": F.size("tokens_b")})
    cls, sep = F.array(F.lit(CLS)), F.array(F.lit(SEP))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    packed = coded.withColumns({
        "input_ids": F.concat(cls, F.slice("_ids", F.lit(1), n_a), sep,
                              F.slice("_ids", n_a + 1, n_b), sep),
        "token_type_ids": F.concat(F.array_repeat(F.lit(0), n_a + 2), F.array_repeat(F.lit(1), n_b + 1)),
        "attention_mask": F.array_repeat(F.lit(1), n_a + n_b + 3),
    })
    arrays = ("input_ids", "token_type_ids", "attention_mask")
    packed = packed.withColumns({c: F.when(~F.col("overflow"), F.col(c)) for c in arrays})
    if pad:
        packed = packed.withColumns({c: pad_to(F.col(c), max_length) for c in arrays})
    return packed.drop("tokens_a", "tokens_b", "_ids")


def pad_to(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    """Fill an array with the padding id up to the length limit."""
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(max_length) - F.size(ids)))
