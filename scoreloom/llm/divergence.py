"""How the wording of sources differs, and the terms that set a source apart.

Terms are counted per language and source where the texts are read, and added
up in buckets of terms. A term's share in a group or language is a whole number of billionths, add-one smoothed;
two shares p and q differ by floor((p - q)^2 / q).

*Terms of a group.* The difference grows with the term's count in the group and
falls with its count in the language, and ties go to the earlier term. So a
term that is dominated in all three by ``k`` others cannot be among the first
``k``. Every partition keeps its skyband, the terms dominated by fewer than
``k`` others; skybands are merged in rounds that gather a bounded number of
them; what is left is ranked exactly.

*Pairs of sources.* The sum over all kept terms is split, so that nothing is
done for terms that neither source has: terms of one source against the share
of an unseen term follow from how many terms have which count, and only terms
of both need their counts side by side. These are multiplied in blocks of
sources, whose sums leave the task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from scoreloom.llm.runtime import parts_for, stored, text_bytes
from scoreloom.llm.textvec import flat, hash_runs, portions
from scoreloom.session import settle

LEAST_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
TERM = re.compile(rb"[a-z\x80-\xff]+")
HELD = 1 << 19              # different terms of groups a task holds before it sends them on
HELD_BYTES = 1 << 28        # text a task reads before it does so, about
BLOCK = 128                 # sources of a side in a block of the product
ROWS = 1 << 19              # counts of terms in a block task, about
PAIRS = 1 << 20             # products formed at once
BUCKET_BYTES = 8 << 20      # text whose terms are added up by a task, about
GATHER = 32                 # skybands merged at once
STRIP = 256


# --- counts

_COUNTED = "bucket int, lang string, source string, terms binary, n array<long>, docs array<long>"
_KEPT = "bucket int, lang string, source string, term string, n long, whole long, first boolean, band boolean"
_END = b"\n"                # behind every term of a row; no term holds it


def _count_terms(buckets: int):
    def packed(counts: dict) -> pa.RecordBatch:
        """A row for every group and bucket: its terms back to back, their counts as arrays."""
        raw = np.frombuffer(b"".join(_END.join(n) + _END for n, _ in counts.values() if n), dtype=np.uint8)
        ends = np.flatnonzero(raw == _END[0]) + 1
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        many = np.fromiter((x for n, _ in counts.values() for x in n.values()), np.int64, len(ends))
        docs = np.fromiter((d[t] for n, d in counts.values() for t in n), np.int64, len(ends))
        bucket = (hash_runs(raw, starts, ends - 1) % np.uint64(buckets)).astype(np.int64)
        key = np.repeat(np.arange(len(counts)), np.array([len(n) for n, _ in counts.values()], dtype=np.int64)) * buckets + bucket
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), np.diff(key) != 0)))
        bounds = np.append(cuts, len(key))
        terms = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)])
        raw, places = flat(terms.take(pa.array(order)))
        blobs = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(places[bounds].astype(np.int32)), pa.py_buffer(raw)])
        owner = pa.array(key[cuts] // buckets)
        names = [pa.array([group[i] for group in counts], pa.string()).take(owner) for i in range(2)]
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x[order])) for x in (many, docs)]
        return pa.RecordBatch.from_arrays([pa.array(key[cuts] % buckets, pa.int32()), *names, blobs, *lists],
                                          names=["bucket", "lang", "source", "terms", "n", "docs"])

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences and documents per group and term, for every run of about
        ``HELD`` different terms."""
        counts: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = size = 0
        for batch in portions(batches):
            raw, starts = flat(batch.column("text"))
            data, ends = raw.tobytes().lower(), starts.tolist()
            size += len(data)
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                n, docs = counts[group]
                terms = TERM.findall(data, ends[i], ends[i + 1])
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
            if held > HELD or size > HELD_BYTES:
                yield packed(counts)
                counts.clear()
                held = size = 0
        yield packed(counts)

    return count_terms


def _unpacked(table: pa.Table):
    """Row, term and counts of everything that the rows of a bucket hold."""
    raw, _ = flat(table.column("terms"))
    ends = np.flatnonzero(raw == _END[0])
    raw = raw[raw != _END[0]]
    places = np.concatenate(([0], ends - np.arange(len(ends)))).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(raw)])
    n, docs = (table.column(c).combine_chunks() for c in ("n", "docs"))
    row = np.repeat(np.arange(table.num_rows), np.asarray(pc.list_value_length(n)))
    return row, terms, np.asarray(n.flatten()), np.asarray(docs.flatten())


def _summed(key: np.ndarray, *values: np.ndarray):
    """Different keys in order, where each of them is first, and sums of the values."""
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    return key[order][heads], order[heads], [np.add.reduceat(v[order], heads) for v in values]


def _coded(column) -> tuple[np.ndarray, pa.Array]:
    encoded = column.combine_chunks().dictionary_encode()
    return np.asarray(encoded.indices).astype(np.int64), encoded.dictionary


def _add_up(least_docs: int, k: int):
    def add_up(table: pa.Table) -> pa.Table:
        """Terms of a bucket in enough documents of their language, marked where
        they belong to the skyband of their group."""
        row, terms, n, docs = _unpacked(table)
        (lang, langs), (source, sources) = (_coded(table.column(c)) for c in ("lang", "source"))
        lang, source = lang[row], source[row]
        coded = terms.dictionary_encode()
        term, terms = np.asarray(coded.indices).astype(np.int64), coded.dictionary.cast(pa.string())
        key, _, (n, docs) = _summed((lang * len(sources) + source) * len(terms) + term, n, docs)
        group, term = key // len(terms), key % len(terms)
        lang, source = group // len(sources), group % len(sources)
        of_lang, head, (whole, docs) = _summed(lang * len(terms) + term, n, docs)
        at = np.searchsorted(of_lang, lang * len(terms) + term)
        first = np.zeros(len(n), dtype=bool)
        first[head] = True
        some = np.flatnonzero(docs[at] >= least_docs)
        group, lang, source, term, n, first, whole = (x[some] for x in (group, lang, source, term, n, first, whole[at]))
        place = np.empty(len(terms), dtype=np.int64)
        place[np.asarray(pc.sort_indices(terms.cast(pa.binary())))] = np.arange(len(terms))
        band = np.zeros(len(n), dtype=bool)
        cuts = np.flatnonzero(np.diff(group)) + 1       # rows are in order of group
        for part in np.split(np.arange(len(n)), cuts) if len(n) else []:
            band[part[skyband(n[part], whole[part], place[term[part]], k)]] = True
        return pa.table({"bucket": pa.array(np.full(len(n), table.column("bucket")[0].as_py()), pa.int32()),
                         "lang": langs.take(pa.array(lang)), "source": sources.take(pa.array(source)), "term": terms.take(pa.array(term)),
                         "n": pa.array(n), "whole": pa.array(whole), "first": pa.array(first), "band": pa.array(band)})

    return add_up


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Counts (bucket, lang, source, term, n, whole: the term's count in the
    language, first: once per term and language, band: of the bucket's skyband
    for ``top``) of terms in at least ``least_docs`` documents of the language,
    and all groups (lang, source) that occur. Both are stored."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    buckets = parts_for(text_bytes(docs), BUCKET_BYTES)
    kept = (docs.select(plain("lang"), plain("source"), F.col("text").cast("string").alias("text")).mapInArrow(_count_terms(buckets), _COUNTED)
            .groupBy("bucket").applyInArrow(_add_up(least_docs, top), _KEPT))
    return stored(kept, "kept"), stored(docs.select(plain("lang"), plain("source")).distinct(), "groups")


def quotient(numerator: Column, denominator: Column) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", numerator, denominator)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact.

    The factor is applied in two steps, so that no product passes 64 bits while
    a language has fewer than 10^14 words.
    """
    wide, rest = 1 << 15, UNIT // (1 << 15)
    left = UNIT - wide * rest               # UNIT = wide * rest + left
    d, c = total + terms, count + 1
    whole, part = quotient(c, d), c % d     # c = whole * d + part
    a, b = quotient(part * wide, d), (part * wide) % d
    # rest * (a * d + b) + left * part, over d
    return 1 + whole * UNIT + a * rest + quotient(b * rest + part * left, d)


def difference(p: Column, q: Column) -> Column:
    return quotient((p - q) * (p - q), q)


def group_table(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Every group: lang, source, sid (number within the language), total,
    seen (kept terms it has), terms (kept terms of the language), lang_total,
    and p0, the share of a term it lacks. Stored."""
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("seen"))
    of_lang = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_total"))

    def number(name):
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)

    rows = (groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
            .select("lang", "source", *[number(c) for c in ("total", "seen", "terms", "lang_total")])
            .withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
            .withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(1)))
    return stored(rows, "group-table")


# --- pairs of sources

def _product(table: pa.Table) -> pa.Table:
    """Sums, over the terms that both sources of a pair have, of what they add
    to the parts that look at one source alone."""
    lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "block_i", "block_j"))
    left = table.column("left").to_numpy()
    names = table.column("term").combine_chunks().dictionary_encode()
    term = np.asarray(names.indices).astype(np.int64)
    sid, p, p0 = (table.column(c).to_numpy() for c in ("sid", "p", "p0"))
    order = np.argsort(term, kind="stable")
    term, sid, p, p0, left = term[order], sid[order], p[order], p0[order], left[order].astype(bool)
    right = np.flatnonzero(table.column("right").to_numpy()[order])
    left = np.flatnonzero(left)
    first, size = np.searchsorted(term[right], term[left], "left"), None
    size = np.searchsorted(term[right], term[left], "right") - first
    out = np.zeros(BLOCK * BLOCK, dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        g = np.repeat(left[at:to], size[at:to])
        shift = np.cumsum(size[at:to]) - size[at:to]
        h = right[np.repeat(first[at:to] - shift, size[at:to]) + np.arange(len(g))]
        other = sid[g] != sid[h]
        g, h = g[other], h[other]

        def apart(x, y):
            return (x - y) ** 2 // y

        add = apart(p[g], p[h]) - apart(p[g], p0[h]) - apart(p0[g], p[h]) + apart(p0[g], p0[h])
        np.add.at(out, sid[g] % BLOCK * BLOCK + sid[h] % BLOCK, add)
        at = to
    cells = np.flatnonzero(out)
    return pa.table({"lang": pa.array([lang] * len(cells), pa.string()),
                     "g": pa.array(i * BLOCK + cells // BLOCK, pa.int32()), "h": pa.array(j * BLOCK + cells % BLOCK, pa.int32()),
                     "part": pa.array(out[cells], pa.int64())})


def _dealt(counts: DataFrame, blocks: int) -> DataFrame:
    """Every count as a left factor in the products (its block, any) and as a
    right one in (any, its block); one row serves both in (its block, its block)."""
    if blocks == 1:
        return counts.withColumns({"block_i": F.lit(0), "block_j": F.lit(0), "left": F.lit(True), "right": F.lit(True)})
    block = F.floor(F.col("sid") / BLOCK).cast("int")
    spread = counts.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    same = block == F.col("other")
    left = spread.withColumns({"block_i": block, "block_j": F.col("other"), "left": F.lit(True), "right": same})
    right = spread.where(~same).withColumns({"block_i": F.col("other"), "block_j": block, "left": F.lit(False), "right": F.lit(True)})
    return left.unionByName(right).drop("other")


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the summed
    differences of the item's shares from the source's."""
    facts = settle(groups.select("lang", "source", "sid", "total", "terms", "p0", "lang_total"))
    known = (kept.join(facts, ["lang", "source"])
             .select("lang", "sid", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0"))
    # The number of sources is known once the groups are stored; blocks and slices follow from it and from the rows.
    most = (groups.agg(F.max("sid")).first()[0] or 0) // BLOCK + 1
    slices = parts_for(kept.count() * most, ROWS)
    sliced = known.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int"))
    dealt = _dealt(sliced, most)
    both = (dealt.groupBy("lang", "block_i", "block_j", "slice")
            .applyInArrow(_product, "lang string, g int, h int, part long")
            .select("lang", "g", "h", F.col("part").cast("decimal(38,0)").alias("part")))

    def exact(column):
        return column.cast("decimal(19,0)")

    sides = facts.select("lang", F.col("sid").alias("other_sid"), F.col("p0").alias("other_p0"))
    alike = known.groupBy("lang", "sid", "p", "p0").agg(F.count(F.lit(1)).cast("decimal(18,0)").alias("many"))
    against = alike.join(sides, "lang").where(F.col("sid") != F.col("other_sid"))
    lone = F.array(
        F.struct(F.col("sid").alias("g"), F.col("other_sid").alias("h"), (F.col("many") * exact(difference(F.col("p"), F.col("other_p0")))).alias("part")),
        F.struct(F.col("other_sid").alias("g"), F.col("sid").alias("h"), (F.col("many") * exact(difference(F.col("other_p0"), F.col("p")))).alias("part")))
    one = against.select("lang", F.explode(lone).alias("w")).select("lang", "w.g", "w.h", F.col("w.part").cast("decimal(38,0)").alias("part"))

    g = groups.select("lang", F.col("sid").alias("g"), "source", "seen", "terms", "p0")
    h = groups.select("lang", F.col("sid").alias("h"), F.col("source").alias("item"), F.col("seen").alias("item_seen"), F.col("p0").alias("item_p0"))
    pairs = g.join(h, "lang").where("g <> h")
    unseen = (F.col("terms") - F.col("seen") - F.col("item_seen")).cast("decimal(18,0)") * exact(difference(F.col("p0"), F.col("item_p0")))
    none = pairs.select("lang", "g", "h", "source", "item", unseen.cast("decimal(38,0)").alias("part"))

    def nameless(df):
        return df.select("lang", "g", "h", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("item"), "part")

    return (none.unionByName(nameless(one)).unionByName(nameless(both)).groupBy("lang", "g", "h")
            .agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("part").cast("long").alias("value"))
            .select("lang", "source", "item", "value"))


# --- terms of a group

def skyband(n: np.ndarray, whole: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which entries are dominated by fewer than ``k`` others: higher or equal
    ``n``, lower or equal ``whole``, earlier ``place`` (a different one each)."""
    order = np.lexsort((place, whole, -n))          # nobody is dominated by one behind
    # Of equal n and whole, only the first k places can be kept.
    new_cell = np.concatenate(([True], (np.diff(n[order]) != 0) | (np.diff(whole[order]) != 0)))
    heads = np.flatnonzero(new_cell)
    nth = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    order = order[nth < k]
    whole, place = np.unique(whole, return_inverse=True)[1].astype(np.int32), place.astype(np.int32)
    kept = np.zeros(0, dtype=np.int64)
    for at in range(0, len(order), STRIP):
        new = order[at:at + STRIP]
        # Whoever has k dominators has k of them in the skyband, so these are all to be counted.
        ahead = np.concatenate((kept, new))
        over = (whole[ahead][None, :] <= whole[new][:, None]) & (place[ahead][None, :] < place[new][:, None])
        over[:, len(kept):] &= np.tri(len(new), k=-1, dtype=bool)
        kept = np.concatenate((kept, new[np.count_nonzero(over, axis=1) < k]))
    return kept


def _merge(k: int):
    def merge(table: pa.Table) -> pa.Table:
        """The skyband of a group's skybands."""
        n, whole = table.column("n").to_numpy(), table.column("whole").to_numpy()
        place = np.empty(len(n), dtype=np.int64)
        place[np.asarray(pc.sort_indices(table.column("term").cast(pa.binary())))] = np.arange(len(n))
        return table.take(pa.array(skyband(n, whole, place, k)))

    return merge


def distinguishing_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the ``top`` terms whose share in the
    group exceeds that in the language by most. The bands of ``kept`` must have
    been made for ``top`` or more."""
    facts = settle(groups.select("lang", "source", "sid", "total", "terms", "lang_total"))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("whole"), F.col("lang_total"), F.col("terms"))
    # A term above its language is dominated by such terms only.
    bands = kept.where("band").join(facts, ["lang", "source"]).where(p > q).select("lang", "sid", F.col("bucket").alias("slot"), "term", "n", "whole")
    slots = (kept.agg(F.max("bucket")).first()[0] or 0) + 1
    while slots > 1:
        slots = -(-slots // GATHER)
        bands = (bands.withColumn("slot", (F.col("slot") % slots).cast("int")).groupBy("lang", "sid", "slot")
                 .applyInArrow(_merge(top), "lang string, sid int, slot int, term string, n long, whole long"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (bands.join(facts, ["lang", "sid"]).select("lang", "source", F.col("term").alias("item"), difference(p, q).alias("value"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))


def audit(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    NULL text, lang and source are empty strings. Every group that occurs has
    its pairs, with value 0 if the language keeps no term; a group whose terms
    are all rarer than in its language has no ``term`` rows. Ties go to the item
    that is earlier in UTF-8. Every row counts as a document, repeated ones
    too; further columns are ignored; an empty table gives no rows.
    """
    kept, names = term_counts(docs, least_docs, top)
    groups = group_table(kept, names)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups).withColumn("rank", F.row_number().over(best))
    terms = distinguishing_terms(kept, groups, top)
    return (pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
            .unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")))
