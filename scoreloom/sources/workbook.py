"""Folders of .xlsx workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scoreloom.operators.numbering import FILE, PLACE, dense_numbers
from scoreloom.schema import ROW_ID, SOURCE_HEADERS

# XML namespaces of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Characters XML cannot hold are written as _xHHHH_ in workbooks.
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNWRITABLE = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
# Rows handed to Spark at a time, and rows of a workbook that is written.
CHUNK = 500
BOOK = 1_000


def _text_of(node) -> str:
    text = "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag == f"{_MAIN}si":
                strings.append(_text_of(node))
                node.clear()
    return strings


def _first_sheet(book: zipfile.ZipFile) -> str:
    listing = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(listing.iter(f"{_MAIN}sheet"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links.iter(f"{_PACKAGE}Relationship")
                  if r.get("Id") == sheet.get(f"{_REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _cell_value(cell, strings: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _text_of(cell)
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None or kind == "e":
        return None
    return strings[int(value.text)] if kind == "s" else value.text


def sheet_rows(content: bytes) -> Iterator[dict[int, str | None]]:
    """Rows of the first sheet as {column number: text}, read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _shared_strings(book)
        with book.open(_first_sheet(book)) as part:
            sheet = None
            for event, node in ElementTree.iterparse(part, ("start", "end")):
                if node.tag == f"{_MAIN}sheetData":
                    sheet = node if event == "start" else None
                if event == "start" or node.tag != f"{_MAIN}row":
                    continue
                cells = list(node.iter(f"{_MAIN}c"))
                yield {(_column_number(c.get("r")) if c.get("r") else i): _cell_value(c, strings)
                       for i, c in enumerate(cells)}
                node.clear()
                # The sheet lets go of rows that are done.
                if sheet is not None:
                    sheet.clear()


def parse_workbooks(files: DataFrame, headers: Mapping[str, str] = SOURCE_HEADERS,
                    extra: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """Graded rows from a table with a binary ``content`` column, one workbook per row.

    The first sheet row names the columns; columns go by name. Every value is
    text. A workbook without a required column stops the job. With ``placed``
    the table also has ``path``, and rows get it and their place in the sheet.
    """
    wanted = {**headers, **{e: e for e in extra}}
    names = list(wanted.values())
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if placed:
        names = [*names, FILE, PLACE]
        schema = schema.add(FILE, T.StringType()).add(PLACE, T.LongType())

    def table(chunk: list[list]) -> pa.RecordBatch:
        columns = list(zip(*chunk))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == PLACE else pa.string()) for n, c in zip(names, columns)], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                # One workbook at a time leaves the batch.
                path = batch.column("path")[k].as_py() if placed else None
                rows = sheet_rows(batch.column("content")[k].as_py())
                title = {v.strip(): k for k, v in next(rows, {}).items() if v}
                missing = [h for h in headers if h not in title]
                if missing:
                    raise ValueError(f"workbook without columns {missing}")
                places = [title.get(h) for h in wanted]
                chunk = []
                for at, row in enumerate(rows):
                    chunk.append([row.get(i) for i in places] + ([path, at] if placed else []))
                    if len(chunk) == CHUNK:
                        yield table(chunk)
                        chunk = []
                if chunk:
                    yield table(chunk)

    return files.select("content", *(["path"] if placed else [])).mapInArrow(parse, schema)


def read_workbooks(spark: SparkSession, path: str, headers: Mapping[str, str] = SOURCE_HEADERS,
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """Scan every .xlsx file of a folder, files in parallel.

    ``row_id`` is taken from the sheet if it is among ``extra``. Otherwise rows
    are numbered from 0 in order of file name and row, for which they are
    written once.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", True).load(path))
    if ROW_ID in extra:
        return parse_workbooks(files, headers, extra)
    return dense_numbers(parse_workbooks(files, headers, extra, placed=True), (FILE,))


def write_workbooks(df: DataFrame, path: str, headers: Mapping[str, str] = SOURCE_HEADERS,
                    extra: tuple[str, ...] = ()) -> int:
    """Write graded rows as .xlsx files below ``path``, which all executors share.

    The tasks write the files themselves, each when it is full, named by
    partition and number. A file has ``BOOK`` rows, so a repeated task writes
    the same files again. Returns the number of files.
    """
    columns, title = _outward(headers, extra)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        for n, content in enumerate(_books(batches, columns, title), 1):
            with files.open_output_stream(f"{folder}/part-{part:05d}-{n - 1:08d}.xlsx") as out:
                out.write(content)
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return df.select(*columns).mapInArrow(place, "files long").agg(F.sum("files")).first()[0] or 0


def workbook_bytes(rows: list[list], header: list[str]) -> bytes:
    """A minimal workbook holding one sheet, for fixtures and exchange.

    Whole and fractional numbers become number cells, anything else text.
    """
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        safe = _UNWRITABLE.sub(lambda m: f"_x{ord(m.group()):04X}_", str(v))
        safe = safe.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{safe}</t></is></c>'

    lines = "".join("<row>" + "".join(cell(v) for v in r) + "</row>" for r in [header, *rows])
    ns, rel, pkg = _MAIN[1:-1], _REL[1:-1], _PACKAGE[1:-1]
    parts = {
        "[Content_Types].xml":
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="xml" ContentType="application/xml"/></Types>',
        "xl/workbook.xml":
            f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>'
            '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels":
            f'<Relationships xmlns="{pkg}"><Relationship Id="rId1" Type="{rel}/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml":
            f'<worksheet xmlns="{ns}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def _outward(headers: Mapping[str, str], extra: tuple[str, ...]) -> tuple[list[str], list[str]]:
    outward = {v: k for k, v in headers.items()}
    columns = [*outward, *extra]
    return columns, [outward.get(c, c) for c in columns]


def _books(batches: Iterator[pa.RecordBatch], columns: list[str], title: list[str]) -> Iterator[bytes]:
    """Workbooks of ``BOOK`` rows, however the rows are batched; one is held at a time."""
    held = []
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            some = batch.slice(at, CHUNK)
            for row in zip(*(some.column(c).to_pylist() for c in columns)):
                held.append(row)
                if len(held) == BOOK:
                    yield workbook_bytes(held, title)
                    held = []
    if held:
        yield workbook_bytes(held, title)


def to_workbooks(df: DataFrame, headers: Mapping[str, str] = SOURCE_HEADERS,
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """(content) rows: one workbook per ``BOOK`` graded rows, built in the tasks."""
    columns, title = _outward(headers, extra)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _books(batches, columns, title):
            yield pa.RecordBatch.from_pydict({"content": pa.array([content], pa.binary())})

    return df.select(*columns).mapInArrow(build, "content binary")
