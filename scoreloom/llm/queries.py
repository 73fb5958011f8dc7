"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.llm import (collocations, decontaminate, divergence, mixing, ngram_join, pii, quality, secrets, sentence_pieces, suffix_dedup,
                           token_counts, topk_search, url_filter)
from scoreloom.llm.runtime import table

QUERIES = {}
CHECKS = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


# --- word-piece counts -------------------------------------------------------

@query("op4_token_counts")
def _(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.read_vocabulary(spark))


# --- URL filter --------------------------------------------------------------

def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"


_CANONICAL = "regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')"
_LONGEST = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
_RULE = " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST)
_VERDICT = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _LONGEST)


@query("op5_url_filter", f"""
  WITH cut AS (SELECT page_id, url,
      CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
      CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') ELSE '' END AS path
    FROM pages),
  named AS (SELECT *, {_CANONICAL} AS canonical FROM cut),
  listed AS (SELECT canonical FROM named WHERE canonical <> '' GROUP BY canonical HAVING min(url) <> max(url))
  SELECT page_id, host, path, CASE {_RULE} END AS rule,
    CASE {_VERDICT} WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM named""")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.readdressed(pages))


# --- exact top-k -------------------------------------------------------------

@query("op6_topk_search", """
  WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
  SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20""")
def _(spark, sf_dir):
    return topk_search.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# --- mixing ------------------------------------------------------------------

def _draw_sql(word: int) -> str:
    return f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{mixing.SEED}'), {1 + 8 * word}, 8))::BIGINT"


def _seats_sql(parties: str, claim: str, seats: str, within: str, name: str) -> str:
    """All quotients of every party, ranked: the definition, without the bounds."""
    keys = ", ".join(x for x in (within, name) if x)
    part = f"PARTITION BY {within}" if within else ""
    return f"""SELECT {keys}, count(*) AS won FROM (
      SELECT {keys}, seats, row_number() OVER ({part} ORDER BY claim / (2 * k + 1) DESC, {name}, k) AS place FROM (
        SELECT {keys}, {seats} AS seats, {claim}::DOUBLE AS claim, unnest(range(most)) AS k FROM {parties}))
    WHERE place <= seats GROUP BY {keys}"""


@query("op7_mixing", f"""
  WITH sizes AS (SELECT doc_id, source,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
  per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
  named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM per),
  weighed AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM named),
  run AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS w_all,
      coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(weight) OVER f, 0) AS w_before FROM weighed
    WINDOW f AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  stops AS (SELECT *, cap / weight <= (total - cap_before) / (w_all - w_before) AS stopped FROM run),
  targets AS (SELECT sid, source, source_size, CASE WHEN stopped THEN cap ELSE
      weight * (total - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ())
        / (w_all - sum(CASE WHEN stopped THEN weight ELSE 0 END) OVER ()) END AS target FROM stops),
  parties AS (SELECT *, (sum(source_size) OVER () // {mixing.BLOCK})::BIGINT AS seats, (3 * source_size) // {mixing.BLOCK} AS most FROM targets),
  of_source AS ({_seats_sql('parties', 'target', 'seats', '', 'sid')}),
  rows AS (SELECT doc_id, s.source, size, sid, source_size, target,
      {_draw_sql(0)} % greatest(ceil(source_size / {mixing.SHARD})::BIGINT, 1) AS shard, {_draw_sql(1)} AS place
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
  parts AS (SELECT r.sid, shard, sum(size)::BIGINT AS shard_size, (3 * sum(size) // {mixing.BLOCK})::BIGINT AS most, any_value(o.won) AS source_seats
    FROM rows r LEFT JOIN of_source o USING (sid) GROUP BY r.sid, shard),
  of_shard AS ({_seats_sql('parts', 'shard_size', 'source_seats', 'sid', 'shard')}),
  quota AS (SELECT sid, shard, shard_size, coalesce(won, 0) * {mixing.BLOCK} AS quota FROM parts LEFT JOIN of_shard USING (sid, shard)),
  placed AS (SELECT rows.*, shard_size, quota, sum(size) OVER (PARTITION BY sid, shard ORDER BY place, doc_id, size
      ROWS UNBOUNDED PRECEDING) - size AS front FROM rows JOIN quota USING (sid, shard))
  SELECT doc_id, source, size, source_size, target, (CASE WHEN shard_size > 0 THEN (quota // shard_size) * size
      + greatest(0, least(size, quota % shard_size - front)) ELSE 0 END)::BIGINT AS taken FROM placed""")
def _(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


# --- suffix-array removal of repeats -----------------------------------------

@query("op1_suffix_dedup")
def _(spark, sf_dir):
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


# --- benchmark decontamination -----------------------------------------------

_WORDS10 = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


@query("op10_decontaminate", f"""
  WITH items AS (SELECT item_id, {_WORDS10} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
    SELECT item_id, unnest([w[i:i + 12] FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS win FROM items WHERE len(w) > 0)),
  docs AS (SELECT doc_id, {_WORDS10} AS w FROM documents),
  placed AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
  matches AS (SELECT DISTINCT p.doc_id, p.i, p.n, x.item_id FROM placed p JOIN windows x USING (n, win)),
  hit AS (SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM (SELECT DISTINCT doc_id, i, n FROM matches)) GROUP BY doc_id),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (
    SELECT DISTINCT doc_id, item_id FROM matches) GROUP BY doc_id)
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""")
def _(spark, sf_dir):
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


# --- personal data -----------------------------------------------------------

@query("op3_pii")
def _(spark, sf_dir):
    rows = pii.personal_data(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.spelled("base"), 256).alias("base_sha256"), pii.spelled("spans").alias("spans"))


# --- n-gram Jaccard join -----------------------------------------------------

@query("op2_ngram_join")
def _(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


# --- quality classifier ------------------------------------------------------

@query("op8_quality")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


# --- secrets -----------------------------------------------------------------

@query("op9_secrets")
def _(spark, sf_dir):
    rows = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(secrets.spelled("base"), 256).alias("base_sha256"),
                       secrets.spelled("spans").alias("spans"))


# --- divergence of sources -----------------------------------------------------

_TERM11 = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _share_sql(count: str, total: str, terms: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + 1)) // ({total} + {terms})::HUGEINT)"


@query("op11_divergence", f"""
  WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_transform(
      regexp_extract_all(coalesce(text, ''), '{_TERM11}'),
      lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
  kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 3),
  counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs)
    JOIN kept USING (lang, term) GROUP BY lang, source, term),
  whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term),
  langs AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM whole GROUP BY lang),
  parties AS (SELECT lang, source, coalesce(terms, 0) AS terms, coalesce(l.total, 0) AS lang_total, coalesce(sum(c.n), 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
  dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_share_sql('coalesce(c.n, 0)', 'g.total', 'g.terms')} AS p
    FROM parties g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
  pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(v.value, 0)::BIGINT AS value FROM parties g
    JOIN parties h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a
      JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) v
    ON v.lang = g.lang AND v.source = g.source AND v.item = h.source),
  terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM (
      SELECT d.lang, d.source, d.term, d.p, {_share_sql('w.n', 'l.total', 'l.terms')} AS q FROM dense d
      JOIN whole w USING (lang, term) JOIN langs l USING (lang) WHERE d.n > 0) WHERE p > q)
  SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 200""")
def _(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


# --- SentencePiece encoding and decoding --------------------------------------

@query("op12_sentence_pieces")
def _(spark, sf_dir):
    model = sentence_pieces.read_model()
    rows = sentence_pieces.encode(table(spark, sf_dir, "documents"), model, decoded=True)

    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("n_bytes"))


# --- collocations ----------------------------------------------------------------

_LOW13 = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op13_collocations", f"""
  WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {_LOW13} AS text FROM documents),
  pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM docs)),
  sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
  grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k))),
  f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
  cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
  cuts AS (SELECT c.lang, c.phrase, c.k, c.a, c.w, pos, l.a AS l, r.a AS r, (2000000 * c.a) // (l.a + r.a) AS score FROM (
      SELECT *, unnest(range(1, k)) AS pos FROM cand) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:pos], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[pos + 1:], ' ')),
  scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
  inner_parts AS (SELECT DISTINCT lang, phrase, a, array_to_string(w[i:i + m - 1], ' ') AS part FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand))),
  covering AS (SELECT lang, part, max(a) AS most FROM inner_parts GROUP BY ALL),
  left_over AS (SELECT s.* FROM scored s LEFT JOIN covering c ON c.lang = s.lang AND c.part = s.phrase
    WHERE most IS NULL OR 100 * most < 80 * a)
  SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over) JOIN sizes USING (lang)
  WHERE rank <= 2000""")
def _(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
