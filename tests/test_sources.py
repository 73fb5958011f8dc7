"""Files in and out."""

import json
import pathlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom.operators import cleaning
from scoreloom.operators.numbering import dense_numbers
from scoreloom.schema import FOUR_GRADES, SOURCE_HEADERS
from scoreloom.sinks import report
from scoreloom.sources import delimited, workbook
from scoreloom.streaming import cells as live

HEADER = ";".join(SOURCE_HEADERS)


def rows(df):
    return sorted((r["question"], r["reference_answer"], r["student_answer"], r["grade"]) for r in df.collect())


def test_cp1251_file(spark, tmp_path):
    body = [HEADER, 'Что такое ток?;"Поток; зарядов";"Он сказал ""да""";5', "q; Ёж №1 – «да»;x;2,0", "q;r;s;NA", "q;;s;3",
            'q;r;"две\nстроки";4']
    (tmp_path / "a.csv").write_bytes("\n".join(body).encode("cp1251"))
    clean = cleaning.drop_incomplete(delimited.read_delimited(spark, str(tmp_path)))
    assert rows(clean) == sorted([
        ("Что такое ток?", "Поток; зарядов", 'Он сказал "да"', "5"), ("q", "Ёж №1 – «да»", "x", "2,0"),
        ("q", "r", "две\nстроки", "4")])
    assert clean.select("row_id").distinct().count() == 3


def test_leading_space_is_kept_on_request(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(f"{HEADER}\nq; r;s;2".encode("cp1251"))
    assert delimited.read_delimited(spark, str(tmp_path)).first()["reference_answer"] == "r"
    assert delimited.read_delimited(spark, str(tmp_path), skip_initial_space=False).first()["reference_answer"] == " r"


def test_columns_go_by_name(spark, tmp_path):
    names = list(SOURCE_HEADERS)[::-1]
    (tmp_path / "a.csv").write_text(";".join(names) + "\n2;s;r;q", encoding="utf-8")
    assert rows(delimited.read_delimited(spark, str(tmp_path), encoding="utf-8")) == [("q", "r", "s", "2")]


def test_file_with_another_header_stops_the_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text(";".join(SOURCE_HEADERS) + "\nq;r;s;2\n" * 1, encoding="utf-8")
    (tmp_path / "b.csv").write_text(";".join(list(SOURCE_HEADERS)[::-1]) + "\n2;s;r;q\n", encoding="utf-8")
    with pytest.raises(Exception, match="CSV header does not conform"):
        delimited.read_delimited(spark, str(tmp_path), encoding="utf-8").collect()


def test_missing_column(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Вопрос;Оценка\nq;2".encode("cp1251"))
    with pytest.raises(ValueError, match="reference_answer"):
        cleaning.drop_incomplete(delimited.read_delimited(spark, str(tmp_path)))


def test_every_cp1251_letter_survives(spark, tmp_path):
    letters = "".join(bytes([b]).decode("cp1251", errors="ignore") for b in range(0x80, 0x100))
    df = spark.createDataFrame([(letters, "r", "s", "2")], list(SOURCE_HEADERS.values()))
    delimited.write_delimited(df, str(tmp_path / "out"))
    row = delimited.read_delimited(spark, str(tmp_path / "out")).first()
    assert row["question"] == letters


def test_a_character_outside_the_code_page_stops_the_job(spark, tmp_path):
    df = spark.createDataFrame([("q", "漢é", "s", "2")], list(SOURCE_HEADERS.values()))
    with pytest.raises(Exception, match="not in cp1251"):
        delimited.write_delimited(df, str(tmp_path / "out"))


def test_spelling_out_is_reversible(spark):
    texts = ["plain", "漢é \\ back", "\\u00E9 written so", "𝄞 clef\nline", "", None, "a\\", "é", "\\uXYZ1 é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", delimited.spell_out(F.col("t")).alias("s")).withColumn("b", delimited.spell_back(F.col("s"))).collect()
    for row in out:
        assert row["b"] == row["t"]
        assert row["s"] is None or row["s"].isascii()


def shared_string_book() -> bytes:
    """A workbook whose texts are shared strings, as spreadsheet programs write it."""
    import io
    import zipfile
    strings = [*SOURCE_HEADERS, "вопрос", "эталон"]
    listing = "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in strings)
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    head = "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCD"))
    sheet = (f'<row r="1">{head}</row><row r="2"><c r="A2" t="s"><v>4</v></c><c r="B2" t="s"><v>5</v></c>'
             '<c r="C2" t="inlineStr"><is><t>ответ</t></is></c><c r="D2"><v>5</v></c></row>'
             '<row r="3"><c r="A3" t="s"><v>4</v></c><c r="C3" t="str"><v>x</v></c><c r="D3"><v>2</v></c></row>')
    buffer = io.BytesIO(workbook.workbook_bytes([], list(SOURCE_HEADERS)))
    out = io.BytesIO()
    with zipfile.ZipFile(buffer) as source, zipfile.ZipFile(out, "w") as target:
        for name in source.namelist():
            if "sheet1" not in name:
                target.writestr(name, source.read(name))
        target.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">{listing}</sst>')
        target.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def test_workbook_folder(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(shared_string_book())
    (tmp_path / "b.xlsx").write_bytes(workbook.workbook_bytes(
        [["q & <a>", "r", "two\nlines \x07 _x0041_", 2.0], ["q", None, "s", 3]], list(SOURCE_HEADERS)))
    (tmp_path / "notes.txt").write_text("not a workbook")
    df = workbook.read_workbooks(spark, str(tmp_path))
    assert df.count() == 4
    assert rows(cleaning.drop_incomplete(df)) == [
        ("q & <a>", "r", "two\nlines \x07 _x0041_", "2"), ("вопрос", "эталон", "ответ", "5")]


def test_rows_are_numbered_alike_however_files_are_packed(spark, tmp_path):
    """Files of very different sizes, repeated rows, an empty file, small splits."""
    for name, lines in (("a", 700), ("b", 1), ("c", 0), ("d", 90)):
        body = "".join(f"{name}{i // 2};r;s;2\n" for i in range(lines))
        (tmp_path / f"{name}.csv").write_text(";".join(SOURCE_HEADERS) + "\n" + body, encoding="cp1251")
    expected = [f"{name}{i // 2}" for name, lines in (("a", 700), ("b", 1), ("d", 90)) for i in range(lines)]
    settings = {"spark.sql.files.maxPartitionBytes": ("128m", "500", "3000"), "spark.sql.files.openCostInBytes": ("4m", "0", "100")}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for i in range(3):
            for key, values in settings.items():
                spark.conf.set(key, values[i])
            df = delimited.read_delimited(spark, str(tmp_path), multi_line=False)
            assert [(r["row_id"], r["question"]) for r in df.orderBy("row_id").collect()] == list(enumerate(expected))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_workbook_rows_are_numbered_in_order(spark, tmp_path):
    for name, n in (("a", 2100), ("b", 0), ("c", 3)):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook.workbook_bytes([[f"{name}{i}", "r", "s", 2] for i in range(n)], list(SOURCE_HEADERS)))
    got = workbook.read_workbooks(spark, str(tmp_path)).orderBy("row_id").collect()
    expected = [f"{name}{i}" for name, n in (("a", 2100), ("c", 3)) for i in range(n)]
    assert [(r["row_id"], r["question"]) for r in got] == list(enumerate(expected))


def test_numbering_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "__file string, __split long, __place long, question string")
    assert dense_numbers(empty).collect() == []


def test_a_run_written_again_replaces_its_document(spark, tmp_path):
    def document(tag, value):
        return spark.createDataFrame([(tag, value)], "run_id string, value int")

    path = str(tmp_path / "r")
    for tag, value in (("1", 10), ("2", 20), ("1", 11)):
        report.write_report(document(tag, value), path)
    assert sorted(spark.read.schema("value int, run_id string").json(path).collect()) == [(11, "1"), (20, "2")]


def test_workbook_without_required_column(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook.workbook_bytes([["q", 2]], ["Вопрос", "Оценка"]))
    with pytest.raises(PySparkException, match="workbook without columns"):
        workbook.read_workbooks(spark, str(tmp_path)).collect()


def test_workbooks_are_written_in_bounded_files(spark, tmp_path):
    wide = spark.range(2500, numPartitions=1).selectExpr(
        "id AS row_id", "CASE WHEN id % 7 > 0 THEN 'вопрос ' || id END AS question", "'r' AS reference_answer", "'s' AS student_answer", "'2' AS grade")
    books = [r["content"] for r in workbook.to_workbooks(wide, extra=("row_id",)).collect()]
    assert [len(list(workbook.sheet_rows(b))) - 1 for b in books] == [1000, 1000, 500]
    path = (tmp_path / "books").as_uri()
    assert workbook.write_workbooks(wide, path, extra=("row_id",)) == 3
    back = workbook.read_workbooks(spark, path, extra=("row_id",)).select("row_id", "question", "grade").collect()
    assert sorted((int(i), q, g) for i, q, g in back) == [(i, f"вопрос {i}" if i % 7 else None, "2") for i in range(2500)]


def test_rows_of_a_sheet_are_let_go():
    import tracemalloc

    def peak(n):
        book = workbook.workbook_bytes([["q", "r", "s", 2]] * n, list(SOURCE_HEADERS))
        tracemalloc.start()
        assert sum(1 for _ in workbook.sheet_rows(book)) == n + 1
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(20_000) < 1.5 * peak(2_000)


def test_long_workbook_is_read_in_chunks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook.workbook_bytes(
        [[f"q{i}", "r", "s", 2] for i in range(5001)], list(SOURCE_HEADERS)))
    assert workbook.read_workbooks(spark, str(tmp_path)).select("question").distinct().count() == 5001


def test_length_report_document(spark, tmp_path):
    df = spark.createDataFrame(
        [(10, 0.5, "2", 0, 0, 0.9), (20, 0.7, "2", 0, 1, 0.6), (120, 1.2, "5", 3, 3, 0.8), (130, 1.5, "5", 3, 3, 0.7)],
        "answer_length int, length_ratio double, grade string, y int, p int, confidence double")
    report.write_report(report.length_report(df, FOUR_GRADES, F.lit("20250101_000000")), str(tmp_path / "r"))
    folder = tmp_path / "r" / "run_id=20250101_000000"
    document = json.loads(next(folder.glob("*.json")).read_text(encoding="utf-8"))
    assert document["accuracy_by_length"]["0-50"] == 0.5 and document["accuracy_by_length"][">1000"] is None
    assert document["accuracy_by_relation"]["100-150%"] == 1.0
    assert document["grade_statistics"]["50%"]["5"] == 125.0 and document["grade_statistics"]["mean"]["3"] is None
    assert document["anova_p"] == pytest.approx(0.004, abs=0.001)


def test_evaluation_report_document(spark):
    from scoreloom.operators.labels import ClassIndex
    df = spark.createDataFrame([(0, 0, 0.9), (1, 0, 0.6), (1, 1, 0.8)], "y int, p int, confidence double")
    row = report.evaluation_report(df, ClassIndex(("2", "5"))).first()
    assert row["confusion_matrix"] == [[1, 0], [1, 1]] and row["class_names"] == ["2", "5"]
    assert row["summary"]["total_samples"] == 3 and row["summary"]["confidence_stats"]["min"] == 0.6
    assert len(row["run_id"]) == 15


def test_stream_of_scored_files(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    scored = spark.createDataFrame([(i % 2, i % 3) for i in range(30)], "y int, p int")
    scored.limit(20).write.mode("append").parquet(source)
    stream = lambda: live.write_cells(live.read_scored(spark, source, scored.schema), out, marks)
    stream().awaitTermination(60)
    spark.createDataFrame([(1, 1)] * 5, scored.schema).write.mode("append").parquet(source)
    stream().awaitTermination(60)
    got = live.read_cells(spark, out).collect()
    assert sum(r["n"] for r in got) == 25
    assert len(list(pathlib.Path(out).glob("batch=*"))) >= 2
