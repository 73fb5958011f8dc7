"""Benchmark decontamination with a positional inverted index.

Terms of the test items are counted in the corpus. Every window of an item is
looked up by its rarest term: only the lists of such terms are stored, as
postings (term, document, position) that carry the words around the position.
A window's lists are then intersected from the rarest term on: its offset gives
the start of a candidate, and the neighbourhood of the posting holds the
offset-adjusted places of all other terms. What is left is an exact phrase.

Words are counted and looked up where the texts are read; only postings of rare
test terms are ever moved. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scoreloom.llm.runtime import stored, text_tag, without

WINDOW = 13
TERMS = 500_000         # test terms up to this number are broadcast, more are joined by shuffle
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word holds everything but ASCII signs. These are listed one by one: java.util.regex looks single
# characters up in a table, but asks every range of a class in turn, for each character of a text.
WORD = "[^" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]+"


def lowered(word: Column) -> Column:
    """A-Z lower-cased, never NULL. ``translate`` looks up one character after another; only words with others than ASCII need it."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.coalesce(F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, _UPPER, _SMALL)), F.lit(""))


def raw_words(text: Column) -> Column:
    """Words of a text as they are written; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for NULL."""
    return raw_words(lowered(text.cast("string")))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Mark a stored table of narrow rows for broadcast if it has at most ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def test_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, window (array of words): every ``width`` consecutive words of an
    item, or all words of a shorter one; items without words have none."""
    cut = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - width + 1, F.lit(1))
    return cut.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.slice("words", i, width))).alias("window")).distinct()


def _placed(docs: DataFrame) -> DataFrame:
    # doc_id alone may repeat or be NULL; with a hash of the text it names the row's content.
    return docs.select(F.col("doc_id"), text_tag(F.col("text")).alias("tag"), F.col("text"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each listed term occurs in all texts: term, n."""
    return (docs.select(F.explode(raw_words(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("term"))
            .join(_checked_broadcast(terms, TERMS), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The index of the listed terms: term, doc_id, tag, position (from 1) and
    the words around it, ``reach`` to each side as far as the text goes."""
    cut = _placed(docs).withColumn("words", raw_words(F.col("text"))).drop("text")
    at = F.col("i") + 1
    around = F.slice("words", F.greatest(at - reach, F.lit(1)), F.least(F.lit(reach), F.col("i")) + reach + 1)
    return (cut.select("doc_id", "tag", "words", F.posexplode("words").alias("i", "word"))
            .withColumn("term", lowered(F.col("word")))
            .join(_checked_broadcast(terms, TERMS), "term")
            .select("term", "doc_id", "tag", at.cast("int").alias("position"),
                    F.least(F.lit(reach), F.col("i")).cast("int").alias("ahead"),
                    F.split(lowered(F.array_join(around, " ")), " ").alias("around")))     # no word holds a blank


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """For every different window its rarest term and the term's offset; windows
    with a term that occurs nowhere cannot match and are left out."""
    placed = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "term"))
    return (placed.join(counts, "term", "left").groupBy("window")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")).alias("least"))
            .where("least.n > 0").select("window", F.col("least.term").alias("term"), F.col("least.offset").alias("offset")))


def phrase_matches(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Exact phrases: doc_id, tag, start (from 1), window."""
    start = F.col("ahead") + 1 - F.col("offset")        # place of the phrase in the neighbourhood
    fits = (start >= 1) & (start + F.size("window") - 1 <= F.size("around"))
    found = F.slice("around", F.greatest(start, F.lit(1)), F.size("window")) == F.col("window")
    return (index.join(anchors, "term").where(fits & found)
            .select("doc_id", "tag", (F.col("position") - F.col("offset")).alias("start"), "window"))


def proximity_matches(index: DataFrame, windows: DataFrame, within: int) -> DataFrame:
    """Looser matches from the same index: all different terms of a window stand
    within ``within`` words to each side of its rarest term, in any order.

    ``windows`` has window, term, offset (see ``rarest_terms``); ``within`` is
    at most the reach of the index. Returns doc_id, tag, position, window.
    """
    first = F.greatest(F.col("ahead") + 1 - within, F.lit(1))
    near = F.slice("around", first, F.col("ahead") + 1 + within - first + 1)
    return (index.join(windows, "term")
            .where(F.size(F.array_except("window", near)) == 0)
            .select("doc_id", "tag", "position", "window").distinct())


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, tag, n_words, n_hit, item_ids, contaminated of every row of ``docs``.

    A word is hit if it is part of any occurrence of a window of an item; a
    document is contaminated if ``share * n_hit >= n_words`` and n_hit > 0.

    NULL and empty texts have no words; items without words match nothing; a
    NULL doc_id is a document like others, a NULL item_id matches but is not
    listed. Repeated rows each get their result. Empty tables give no rows or
    no hits. Further columns are ignored.
    """
    windows = stored(test_windows(items, width), "windows")
    terms = stored(windows.select(F.explode("window").alias("term")).distinct(), "terms")
    counts = stored(term_counts(docs, terms), "term-counts")
    anchors = stored(rarest_terms(windows, counts), "anchors")
    index = stored(postings(docs, anchors.select("term").distinct(), width - 1), "postings")
    matches = stored(phrase_matches(index, anchors).distinct(), "matches")

    name = ["doc_id", "tag"]
    spans = matches.groupBy(*name, "start").agg(F.max(F.size("window")).alias("n"))
    before = Window.partitionBy(*name).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    hit = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.col("start"))))
    hits = spans.withColumn("hit", hit).groupBy(*name).agg(F.sum("hit").cast("long").alias("n_hit"))
    found = (matches.select(*name, "window").distinct().join(windows.where("item_id IS NOT NULL"), "window")
             .select(*name, F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy(*name).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids")))
    per = hits.join(found, hits["doc_id"].eqNullSafe(found["doc_id"]) & (hits["tag"] == found["tag"]), "left").select(
        hits["doc_id"].alias("hit_id"), hits["tag"].alias("hit_tag"), "n_hit", "item_ids")
    base = _placed(docs).withColumn("n_words", n_words(F.col("text"))).drop("text")
    out = base.join(per, base["doc_id"].eqNullSafe(per["hit_id"]) & (base["tag"] == per["hit_tag"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        base["doc_id"], base["tag"], "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs``, all columns, without the contaminated documents."""
    return without(docs, contamination(docs, items, width, share).where("contaminated").select("doc_id", "tag"))
