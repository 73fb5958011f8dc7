"""URL filtering: a blocked Bloom filter in front of an exact hash join.

Two kinds of entries are listed: rules (a host with all its subdomains and the
beginning of a path) and canonical URLs. Their keys set bits in a Bloom filter
whose blocks are single 64-bit words, so a look-up touches one word. Every URL
is turned into the keys that could be listed; only URLs with a possible hit go
on to the exact joins, which remove the false positives.

The filter is broadcast. Its size follows the list up to ``MAX_WORDS``; beyond
that it only passes more false positives, the result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (host, beginning of the path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_RULES = 10_000
MAX_WORDS = 1 << 20
MARK = "\x00"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for NULL or a URL without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without closing slashes."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def rule_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Keys of all rules that could fit, for rule paths of the given lengths."""
    return F.flatten(F.transform(suffixes(host), lambda s: F.array(*[
        F.when(F.length(path) >= n, F.concat(s, F.lit(MARK), F.substring(path, 1, n))) for n in lengths])))


def _bits(h: Column) -> Column:
    """Four bits of a word, chosen by four slices of the hash."""
    one, mask = F.lit(1).cast("long"), F.lit(0).cast("long")
    for shift in (0, 6, 12, 18):
        # shiftleft takes the count from a whole number expression only in SQL
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, F.shiftright(h, shift).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom_words(keys: DataFrame, key: str = "key") -> np.ndarray:
    """The filter of all keys; bits are OR-ed per word before they are gathered."""
    n = keys.count()
    words = 64
    while words < MAX_WORDS and words * 64 < 12 * n:
        words *= 2
    h = F.xxhash64(F.col(key))
    rows = (keys.where(F.col(key).isNotNull())
            .select(F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(words - 1)).cast("int").alias("word"), _bits(h).alias("bits"))
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas())
    out = np.zeros(words, dtype=np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out


def _possible(shared):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("hashes"))
            h = column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.zeros(len(h), dtype=np.int64)
            for shift in (0, 6, 12, 18):
                bits |= np.int64(1) << ((h >> shift) & 63)
            at = (h.view(np.uint64) >> np.uint64(24)).astype(np.int64) & (len(words) - 1)
            hit = (words[at] & bits) == bits
            lengths = np.asarray(column.value_lengths().fill_null(0))
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            possible = np.bincount(owner[hit], minlength=batch.num_rows) > 0
            rest = [i for i, name in enumerate(batch.schema.names) if name != "hashes"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(possible)],
                                             names=[batch.schema.names[i] for i in rest] + ["possible"])

    return look


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
                id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict on the URL of every row: id, host, path, rule, verdict.

    ``listed`` has a column ``canonical`` of URLs to block. A URL takes the
    verdict of the longest rule that fits (rule: host and path as one string;
    ties go to the longer host, then by code point); without a rule it is
    blocked if its canonical form is listed, else allowed.

    A NULL URL or one without ``://`` has empty host and path, fits no rule and
    is allowed. Repeated rows are judged each, NULL ids are kept, further
    columns are ignored, empty tables give no rows and an empty list blocks
    nothing. At most ``MAX_RULES`` rules are taken, so their broadcast is bounded.
    """
    spark = pages.sparkSession
    rules = sorted(set(rules))
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules, at most {MAX_RULES}: give long lists as listed URLs")
    lengths = sorted({len(path) for _, path, _ in rules})
    known = spark.createDataFrame(
        [(f"{h}{MARK}{p}", h + p, v, len(h + p), len(h)) for h, p, v in rules],
        "key string, rule string, rule_verdict string, size int, host_size int")
    urls = listed.where(F.length("canonical") > 0).select(F.col("canonical").alias("key")).distinct()
    words = spark.sparkContext.broadcast(bloom_words(known.select("key").unionAll(urls)))

    cut = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keys = F.concat(rule_keys(F.col("host"), F.col("path"), lengths), F.array(canonical(F.col("host"), F.col("path"))))
    looked = cut.withColumn("hashes", F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.xxhash64(k)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    looked = looked.mapInArrow(_possible(words), f"{fields}, possible boolean")

    hits = looked.where("possible").select("host", "path").distinct()
    fit = (hits.withColumn("key", F.explode(rule_keys(F.col("host"), F.col("path"), lengths)))
           .join(F.broadcast(known), "key")
           .groupBy("host", "path")
           .agg(F.max(F.struct("size", "host_size", "rule", "rule_verdict")).alias("best")))
    named = (hits.withColumn("key", canonical(F.col("host"), F.col("path"))).join(urls, "key")
             .select("host", "path", F.lit("block").alias("listed")))
    judged = hits.join(fit, ["host", "path"], "left").join(named, ["host", "path"], "left").select(
        "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", "listed", F.lit("allow")).alias("verdict"))
    return looked.join(judged, ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def readdressed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs found under several spellings: a list taken from a crawl."""
    named = pages.select(canonical(host_of(F.col(url)), path_of(F.col(url))).alias("canonical"), F.col(url).alias("raw"))
    return (named.where("length(canonical) > 0").groupBy("canonical")
            .agg(F.min("raw").alias("least"), F.max("raw").alias("most"))
            .where("least <> most").select("canonical"))
