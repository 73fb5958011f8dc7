"""Delimited graded-answer files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scoreloom.operators.numbering import dense_numbers, file_places
from scoreloom.schema import ROW_ID, SOURCE_HEADERS

# Spark reads one-byte files as ISO-8859-1 only. Any other one-byte code page is
# that reading with its upper 128 characters exchanged one by one.
_BYTES = bytes(range(0x80, 0x100))
_LATIN = _BYTES.decode("latin-1")
UTF8 = ("utf-8", "utf8")


def _upper_half(encoding: str) -> str:
    return "".join(bytes([b]).decode(encoding, errors="replace") for b in _BYTES)


def decode_single_byte(c: Column, encoding: str) -> Column:
    """Characters of a one-byte code page from text read as ISO-8859-1."""
    return F.translate(c, _LATIN, _upper_half(encoding))


def encode_single_byte(c: Column, encoding: str) -> Column:
    """The reverse, for writing; a character outside the code page stops the job."""
    upper = _upper_half(encoding).replace("\ufffd", "")
    pairs = [(u, l) for u, l in zip(_upper_half(encoding), _LATIN) if u != "\ufffd"]
    foreign = F.regexp_extract(c, "[^\\x00-\\x7f" + upper + "]", 0)
    complaint = F.concat(F.lit(f"not in {encoding}: "), foreign, F.lit("; spell such characters out first (see spell_out)"))
    checked = F.when(foreign == "", c).when(c.isNotNull(), F.raise_error(complaint).cast("string"))
    return F.translate(checked, "".join(u for u, _ in pairs), "".join(l for _, l in pairs))


def spell_out(c: Column) -> Column:
    """ASCII spelling of any text: other characters, and the backslash, as UTF-16
    units ``\\uXXXX``. ``spell_back`` undoes it."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    apart = F.regexp_extract_all(units, F.lit("[0-9A-F]{4}"), F.lit(0))
    one = F.array_join(F.transform(apart, lambda u: F.when(
        (u <= "007F") & (u != "005C"), F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")).otherwise(
        F.concat(F.lit("\\u"), u))), "")
    return F.when(F.rlike(c, F.lit("[^\\x00-\\x7f]|\\\\")), one).otherwise(c)


def spell_back(c: Column) -> Column:
    parts = F.split(c, "(?=\\\\u[0-9A-F]{4})")
    units = F.array_join(F.transform(parts, lambda p: F.when(
        F.rlike(p, F.lit("^\\\\u[0-9A-F]{4}")), F.concat(F.substring(p, 3, 4), F.hex(F.encode(F.substr(p, F.lit(7)), "UTF-16BE")))).otherwise(
        F.hex(F.encode(p, "UTF-16BE")))), "")
    return F.when(F.contains(c, F.lit("\\u")), F.decode(F.unhex(units), "UTF-16BE")).otherwise(c)


def read_delimited(spark: SparkSession, path: str, encoding: str = "cp1251", sep: str = ";",
                   skip_initial_space: bool = True, multi_line: bool = True,
                   headers: Mapping[str, str] = SOURCE_HEADERS) -> DataFrame:
    """Scan delimited files with a header line.

    Every field is read as text, so there is no inference pass and a grade
    column with gaps cannot turn into fractions. Columns go by name; a file
    whose header differs from the first one's stops the job. Quoted fields may
    hold the separator, quotes and line ends, which makes one file the unit of
    parallel work. Where no field holds a line end, ``multi_line=False`` lets
    Spark split large files.
    ``row_id`` is taken from the input if present. Otherwise rows are numbered
    from 0 in order of file name and line, for which they are written once.
    """
    utf8 = encoding.lower() in UTF8
    raw = (spark.read.option("header", True).option("sep", sep)
           .option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
           .option("multiLine", multi_line).option("quote", '"').option("escape", '"')
           .option("enforceSchema", False)
           .option("ignoreLeadingWhiteSpace", skip_initial_space)
           .option("ignoreTrailingWhiteSpace", False).csv(path))

    def decoded_name(name: str) -> str:
        return name if utf8 else name.encode("latin-1").decode(encoding, errors="replace")

    columns = []
    for name in raw.columns:
        value = F.col(f"`{name}`")
        value = value if utf8 else decode_single_byte(value, encoding)
        plain = decoded_name(name).strip()
        columns.append(value.alias(headers.get(plain, plain)))
    df = raw.select(*columns)
    if ROW_ID in df.columns:
        return df.withColumn(ROW_ID, F.col(ROW_ID).cast("bigint"))
    return dense_numbers(raw.select(*columns, *file_places()))


def write_delimited(df: DataFrame, path: str, encoding: str = "cp1251", sep: str = ";",
                    headers: Mapping[str, str] = SOURCE_HEADERS) -> None:
    """Write a graded table in the form ``read_delimited`` reads."""
    utf8 = encoding.lower() in UTF8
    outward = {v: k for k, v in headers.items()}
    columns = []
    for name in df.columns:
        value = F.col(name).cast("string")
        title = outward.get(name, name)
        if not utf8:
            value = encode_single_byte(value, encoding)
            title = title.encode(encoding).decode("latin-1")
        columns.append(value.alias(title))
    (df.select(*columns).write.option("header", True).option("sep", sep)
     .option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
     .option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
