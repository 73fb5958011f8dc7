"""Scans, cleaning, labels, splits and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions.text import AUGMENT_TEMPLATES, BASELINE_TEMPLATE, DEFAULT_TEMPLATE, TOKEN
from scoreloom.operators import cleaning, encoding, labels, ledger, lengths, prompts, splits
from scoreloom.operators.labels import FOUR_GRADE_INDEX
from scoreloom.plans.adapters import (
    ANSWERS_SQL, BULK_SQL, GRADED_SCORED, GRADED_SQL, ORDERS_SQL, TURNS_SQL, answers, bulk, graded, grades, mix_sql,
    order_grades, raw_graded, table, turn_pairs, with_scores)
from scoreloom.plans.registry import query, steps
from scoreloom.schema import FOUR_GRADES, GRADE, QUESTION, REFERENCE, ROW_ID, STUDENT
from scoreloom.session import scratch_path
from scoreloom.sources import delimited, workbook

_FILE_ROWS = steps(GRADED_SQL, """
  SELECT row_id, grade, length(student_answer)::INT AS answer_length, length(reference_answer)::INT AS reference_length,
    md5('Вопрос ' || question) AS question, md5(student_answer) AS student_answer, md5(reference_answer) AS reference_answer FROM graded""")
_RUSSIAN_ROWS = steps(ANSWERS_SQL, """
  SELECT row_id, grade, md5('Ответ №' || row_id) AS student_answer, md5('Эталон «' || question || '»; ё') AS reference_answer
  FROM (SELECT *, (2 + row_id % 4)::VARCHAR AS grade FROM answers)""")
_TEXTS = (QUESTION, REFERENCE, STUDENT)


def _file_rows(df):
    """What was read, every text as its md5."""
    clean = lengths.length_features(cleaning.drop_incomplete(df))
    return clean.select(F.col(ROW_ID).cast("bigint").alias(ROW_ID), GRADE, "answer_length", "reference_length",
                        *[F.md5(c).alias(c) for c in _TEXTS])


def _titled(spark, sf_dir):
    return graded(spark, sf_dir).withColumn(QUESTION, F.concat(F.lit("Вопрос "), QUESTION))


def _through_csv(spark, sf_dir, **options):
    # Texts in four languages do not fit one code page: they travel spelled out.
    path = scratch_path(spark, "graded-csv")
    delimited.write_delimited(_titled(spark, sf_dir).withColumns({
        c: delimited.spell_out(F.col(c)) for c in (REFERENCE, STUDENT)}), path)
    read = delimited.read_delimited(spark, path, **options)
    return _file_rows(read.withColumns({c: delimited.spell_back(F.col(c)) for c in (REFERENCE, STUDENT)}))


@query("src_csv_scan", _FILE_ROWS)
def _(spark, sf_dir):
    return _through_csv(spark, sf_dir)


@query("src_csv_scan_keep_space", _FILE_ROWS)
def _(spark, sf_dir):
    return _through_csv(spark, sf_dir, skip_initial_space=False)


@query("src_csv_scan_russian", _RUSSIAN_ROWS)
def _(spark, sf_dir):
    """cp1251 as such: Russian texts made of every document, files that split."""
    path = scratch_path(spark, "russian-csv")
    rows = answers(spark, sf_dir).select(
        ROW_ID, QUESTION, (F.lit(2) + F.col(ROW_ID) % 4).cast("string").alias(GRADE),
        F.concat(F.lit("Ответ №"), F.col(ROW_ID)).alias(STUDENT),
        F.concat(F.lit("Эталон «"), QUESTION, F.lit("»; ё")).alias(REFERENCE))
    delimited.write_delimited(rows, path)
    read = cleaning.drop_incomplete(delimited.read_delimited(spark, path, multi_line=False))
    return read.select(ROW_ID, GRADE, F.md5(STUDENT).alias(STUDENT), F.md5(REFERENCE).alias(REFERENCE))


_NUMBERED = """
  SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row_id, o_orderkey::VARCHAR AS question,
    (2 + o_orderkey % 4)::VARCHAR AS grade FROM orders"""


def _keyless(spark, sf_dir):
    """Orders as graded rows without a key, files in order of the order number."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key, key.cast("string").alias(QUESTION), F.md5(key.cast("string")).alias(REFERENCE), F.col("o_orderpriority").alias(STUDENT),
        (F.lit(2) + key % 4).cast("string").alias(GRADE))
    return rows.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").drop("o_orderkey")


@query("src_csv_row_numbers", _NUMBERED)
def _(spark, sf_dir):
    path = scratch_path(spark, "keyless-csv")
    delimited.write_delimited(_keyless(spark, sf_dir), path)
    return delimited.read_delimited(spark, path, multi_line=False).select(ROW_ID, QUESTION, GRADE)


@query("src_workbook_row_numbers", _NUMBERED)
def _(spark, sf_dir):
    path = scratch_path(spark, "keyless-workbooks")
    workbook.write_workbooks(_keyless(spark, sf_dir), path)
    return workbook.read_workbooks(spark, path).select(ROW_ID, QUESTION, GRADE)


@query("src_workbook_scan", _FILE_ROWS)
def _(spark, sf_dir):
    path = scratch_path(spark, "workbooks")
    workbook.write_workbooks(_titled(spark, sf_dir), path, extra=(ROW_ID,))
    return _file_rows(workbook.read_workbooks(spark, path, extra=(ROW_ID,)))


@query("drop_incomplete", steps(GRADED_SQL, """
  SELECT row_id, question, grade, length(student_answer)::INT AS answer_length FROM graded
  WHERE question NOT IN ('src3', 'src5')"""))
def _(spark, sf_dir):
    return cleaning.drop_incomplete(raw_graded(spark, sf_dir)).select(
        ROW_ID, QUESTION, GRADE, F.length(STUDENT).alias("answer_length"))


@query("label_encode", steps(GRADED_SQL, """
  SELECT row_id, grade, (dense_rank() OVER (ORDER BY grade) - 1)::INT AS label FROM graded"""))
def _(spark, sf_dir):
    return labels.encode_labels(grades(spark, sf_dir))


@query("label_encode_fixed", steps(BULK_SQL, """
  SELECT row_id, grade, (list_position(['2', '3', '4', '5'], grade) - 1)::INT AS label FROM bulk"""))
def _(spark, sf_dir):
    return bulk(spark, sf_dir).select(
        ROW_ID, GRADE, labels.ClassIndex(FOUR_GRADES).encode_strict(F.col(GRADE)).alias("label"))


@query("label_encode_unseen", steps(BULK_SQL, ORDERS_SQL, """
  SELECT grade AS class, count(*) AS n FROM order_grades
  WHERE grade NOT IN (SELECT grade FROM bulk) GROUP BY grade"""))
def _(spark, sf_dir):
    # Fitted on one table, used on another that has one more class.
    return labels.unseen_classes(order_grades(spark, sf_dir), labels.fit_classes(bulk(spark, sf_dir)))


@query("label_encode_many", """
  SELECT l_orderkey AS row_id, l_partkey::VARCHAR AS grade,
    (dense_rank() OVER (ORDER BY l_partkey::VARCHAR) - 1)::INT AS label FROM lineitem""")
def _(spark, sf_dir):
    # More classes than a literal index takes.
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(ROW_ID), F.col("l_partkey").cast("string").alias(GRADE))
    return labels.encode_labels(rows)


@query("label_decode", steps(BULK_SQL, "SELECT row_id, (p + 2)::VARCHAR AS predicted_grade FROM bulk"))
def _(spark, sf_dir):
    return bulk(spark, sf_dir).select(ROW_ID, FOUR_GRADE_INDEX.decode(F.col("p")).alias("predicted_grade"))


@query("sample_ledger", steps(*GRADED_SCORED, """
  SELECT row_id, grade AS true_grade, predicted_grade, grade = predicted_grade AS is_correct FROM scored"""))
def _(spark, sf_dir):
    scored = with_scores(grades(spark, sf_dir))
    return ledger.sample_ledger(ledger.with_verdict(scored, FOUR_GRADE_INDEX))


def _wording(text: str) -> str:
    """SQL concatenation for a prompt wording."""
    for slot, column in (("question", QUESTION), ("reference", REFERENCE), ("student", STUDENT)):
        text = text.replace("{" + slot + "}", f"' || {column} || '")
    return f"'{text}'"


@query("prompt_pair", steps(ANSWERS_SQL, f"""
  SELECT row_id, {_wording(DEFAULT_TEMPLATE.text_a)} AS text_a, {_wording(DEFAULT_TEMPLATE.text_b)} AS text_b,
    {_wording(BASELINE_TEMPLATE.text_a)} AS baseline_a, {_wording(BASELINE_TEMPLATE.text_b)} AS baseline_b FROM answers"""))
def _(spark, sf_dir):
    baseline = prompts.baseline_pair(answers(spark, sf_dir)).withColumnsRenamed(
        {"text_a": "baseline_a", "text_b": "baseline_b"})
    return prompts.prompt_pair(baseline).select(ROW_ID, "text_a", "text_b", "baseline_a", "baseline_b")


def _augmented_sql(side: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {_wording(getattr(t, side))}" for i, t in enumerate(AUGMENT_TEMPLATES))
    return f"CASE template_id {arms} ELSE {_wording(getattr(DEFAULT_TEMPLATE, side))} END"


_EPOCHS = 3


@query("augment_templates", steps(TURNS_SQL, ("drawn", f"""
  SELECT *, CASE WHEN ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.7
      THEN (('0x' || substr(h, 9, 8))::BIGINT % 7)::INT ELSE -1 END AS template_id
  FROM (SELECT *, md5(row_id::VARCHAR || ':' || epoch::VARCHAR || ':42') AS h
    FROM turn_pairs, (SELECT k::INT AS epoch FROM range(1, {_EPOCHS + 1}) r(k)))"""), f"""
  SELECT row_id, epoch, template_id, {_augmented_sql('text_a')} AS text_a, {_augmented_sql('text_b')} AS text_b FROM drawn"""))
def _(spark, sf_dir):
    return prompts.augmented_pair(turn_pairs(spark, sf_dir), _EPOCHS).select(
        ROW_ID, "epoch", "template_id", "text_a", "text_b")


_VOCABULARY = 50_000
_TEXT_TABLES = ("texts", "SELECT source AS t FROM documents UNION ALL SELECT text FROM documents UNION ALL SELECT text FROM benchmark")
_PAIR_TEXTS = ("texts", "SELECT unnest([question, reference_answer, student_answer]) AS t FROM pairs_in")


def _vocabulary_sql(size: int):
    return ("vocabulary", f"""
  SELECT (row_number() OVER (ORDER BY n DESC, token) + 3)::INT AS token_id, token, n FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '{TOKEN}')) AS token FROM texts)
    GROUP BY token ORDER BY n DESC, token LIMIT {size})""")


def _corpus_counts(spark, sf_dir):
    """All documents and every benchmark text once, labelled or not."""
    return encoding.sum_counts(encoding.token_counts(table(spark, sf_dir, "documents"), "source", "text"),
                               encoding.token_counts(table(spark, sf_dir, "benchmark"), "text"))


_VOCABULARY_CHECK = steps(_TEXT_TABLES, _vocabulary_sql(_VOCABULARY), "SELECT * FROM vocabulary")


@query("vocab_topk", _VOCABULARY_CHECK)
def _(spark, sf_dir):
    return encoding.vocabulary(_corpus_counts(spark, sf_dir), _VOCABULARY)


@query("vocab_saved", _VOCABULARY_CHECK)
def _(spark, sf_dir):
    path = scratch_path(spark, "vocabulary")
    encoding.save_vocabulary(encoding.vocabulary(_corpus_counts(spark, sf_dir), _VOCABULARY), path)
    return encoding.load_vocabulary(spark, path)


_MAX = encoding.MAX_LENGTH
_PAIR_TOKENS = ("pairs", f"""
  SELECT *, greatest({_MAX} - 3 - len(ta), 0) AS room, len(ta) > {_MAX} - 3 AS overflow FROM (
    SELECT row_id, label, regexp_extract_all({_wording(DEFAULT_TEMPLATE.text_a)}, '{TOKEN}') AS ta,
      regexp_extract_all({_wording(DEFAULT_TEMPLATE.text_b)}, '{TOKEN}') AS tb FROM pairs_in)""")
_PAIR_FINAL = f"""
  SELECT row_id, label, overflow,
    CASE WHEN overflow THEN NULL ELSE len(ta) END::INT AS n_a,
    CASE WHEN overflow THEN NULL ELSE nb END::INT AS n_b,
    CASE WHEN overflow THEN NULL ELSE array_to_string(
      [2] || coalesce(aids, []) || [3] || coalesce(bids, []) || [3]
        || list_transform(range({_MAX} - 3 - len(ta) - nb), lambda i: 0), ' ') END AS input_ids,
    CASE WHEN overflow THEN NULL ELSE array_to_string(list_transform(range({_MAX}),
      lambda i: CASE WHEN i >= len(ta) + 2 AND i < len(ta) + nb + 3 THEN 1 ELSE 0 END), ' ') END AS token_type_ids,
    CASE WHEN overflow THEN NULL ELSE array_to_string(list_transform(range({_MAX}),
      lambda i: CASE WHEN i < len(ta) + nb + 3 THEN 1 ELSE 0 END), ' ') END AS attention_mask
  FROM (SELECT p.*, least(len(tb), room) AS nb, a.ids AS aids, b.ids AS bids
    FROM pairs p LEFT JOIN ida a USING (row_id) LEFT JOIN idb b USING (row_id))"""


def _pair_ids(side: str, lookup: str, cut: str):
    return f"""SELECT row_id, list(id ORDER BY pos) AS ids FROM (
      SELECT row_id, pos, {lookup} AS id FROM (
        SELECT row_id, unnest({side}{cut}) AS token, generate_subscripts({side}{cut}, 1) AS pos FROM pairs WHERE NOT overflow) x
      LEFT JOIN vocabulary v USING (token)) GROUP BY row_id"""


def _pair_sql(source, vocabulary, lookup):
    return steps(*source, *vocabulary, _PAIR_TOKENS,
                 ("ida", _pair_ids("ta", lookup, "")), ("idb", _pair_ids("tb", lookup, "[1:room]")), _PAIR_FINAL)


_LABELLED = (GRADED_SQL, ("pairs_in", "SELECT *, grade::INT - 2 AS label FROM graded"))
_TURN_PAIRS = (TURNS_SQL, ("pairs_in", "SELECT *, (row_id % 4)::INT AS label FROM turn_pairs"))


def _labelled(spark, sf_dir):
    return graded(spark, sf_dir).withColumn("label", FOUR_GRADE_INDEX.encode_strict(F.col(GRADE)))


def _encoded(pairs, ids):
    coded = encoding.pair_encode(prompts.prompt_pair(pairs).select(ROW_ID, "label", "text_a", "text_b"), ids, _MAX)

    def spelled(c):
        return F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)

    return coded.select(ROW_ID, "label", "overflow", "n_a", "n_b", spelled("input_ids"),
                        spelled("token_type_ids"), spelled("attention_mask"))


_BY_VOCABULARY = _pair_sql(_LABELLED, (_PAIR_TEXTS, _vocabulary_sql(_VOCABULARY)), "coalesce(v.token_id, 1)")


def _pair_vocabulary(pairs):
    return encoding.vocabulary(encoding.token_counts(pairs, QUESTION, REFERENCE, STUDENT), _VOCABULARY)


@query("pair_encode", _BY_VOCABULARY)
def _(spark, sf_dir):
    pairs = _labelled(spark, sf_dir)
    return _encoded(pairs, encoding.fit_token_ids(_pair_vocabulary(pairs)))


@query("pair_encode_joined", _BY_VOCABULARY)
def _(spark, sf_dir):
    """The path of a vocabulary too large for the driver, read back from where it was saved."""
    pairs = _labelled(spark, sf_dir)
    path = scratch_path(spark, "vocabulary")
    encoding.save_vocabulary(_pair_vocabulary(pairs), path)
    return _encoded(pairs, encoding.load_vocabulary(spark, path))


@query("pair_encode_hashed", _pair_sql(
    _TURN_PAIRS, (("vocabulary", "SELECT '' AS token, 0 AS token_id"),),
    "((('0x' || substr(md5(token), 1, 8))::BIGINT) % 30000 + 4)::INT"))
def _(spark, sf_dir):
    return _encoded(turn_pairs(spark, sf_dir).withColumn("label", (F.col(ROW_ID) % 4).cast("int")), 30000)


def split_sql(source: str, names, keep, output: str) -> tuple:
    """Two-way cuts by largest remainder, then ranks over the whole stratum."""
    parts = [("ordered", f"""
      SELECT row_id, grade, row_number() OVER (PARTITION BY grade ORDER BY
        {mix_sql('row_id', splits.SEED)}, row_id) AS rn FROM {source}"""),
             ("left0", "SELECT grade, count(*) AS n, 0::BIGINT AS used FROM ordered GROUP BY grade")]
    for i, share in enumerate(keep):
        parts += [(f"target{i}", f"SELECT floor({share} * sum(n) + 1e-9)::HUGEINT AS t, sum(n) AS total FROM left{i}"),
                  (f"size{i}", f"""
      SELECT grade, n, used, whole + CASE WHEN row_number() OVER (ORDER BY n * t - whole * total DESC, grade)
          <= t - sum(whole) OVER () THEN 1 ELSE 0 END AS size
      FROM (SELECT *, (n * t) // total AS whole FROM left{i}, target{i})"""),
                  (f"left{i + 1}", f"SELECT grade, n - size AS n, used + size AS used FROM size{i}")]
    cuts = " ".join(f"WHEN rn <= (SELECT used FROM left{i + 1} c WHERE c.grade = o.grade) THEN '{names[i]}'"
                    for i in range(len(keep)))
    parts.append(("split_rows", f"SELECT row_id, grade, CASE {cuts} ELSE '{names[-1]}' END AS split FROM ordered o"))
    return (*parts, output)


_THREE = splits.THREE_WAY
_TWO = splits.TWO_WAY


@query("stratified_split_3way", steps(GRADED_SQL, *split_sql(
    "graded", _THREE["names"], _THREE["keep"], "SELECT row_id, grade, split FROM split_rows")))
def _(spark, sf_dir):
    return splits.stratified_split(grades(spark, sf_dir), GRADE, **_THREE)


@query("stratified_split_2way", steps(ORDERS_SQL, *split_sql(
    "order_grades", _TWO["names"], _TWO["keep"], "SELECT row_id, grade, split FROM split_rows")))
def _(spark, sf_dir):
    return splits.stratified_split(order_grades(spark, sf_dir), GRADE, **_TWO)


@query("split_sizes", steps(ORDERS_SQL, *split_sql(
    "order_grades", _THREE["names"], _THREE["keep"], "SELECT split, grade, count(*) AS n FROM split_rows GROUP BY ALL")))
def _(spark, sf_dir):
    return splits.split_sizes(splits.stratified_split(order_grades(spark, sf_dir), GRADE, **_THREE), GRADE)
