"""Repeatable pseudo-random draws that depend only on the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scoreloom.schema import WHOLE_NUMBERS

BITS = 32
MASK = (1 << BITS) - 1
# Two odd multipliers below 2**31, so that a product with a
# 32-bit number fits into a signed 64-bit one.
MULTIPLIERS = (0x7FEB352D, 0x6C8E9CF5)


def draw(*parts: Column, word: int = 0) -> Column:
    """A 32-bit whole number from the md5 of the parts joined by colons.

    ``word`` picks one of the four independent 32-bit words of the digest.
    md5 is used because other SQL engines can repeat it; the draw does not
    depend on partitioning, task retries or the Spark version. It is never
    NULL, which spares joins and filters on it a second evaluation.
    """
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    number = F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint"))


def uniform(*parts: Column, word: int = 0) -> Column:
    """A draw scaled to [0, 1)."""
    return draw(*parts, word=word) / F.lit(float(1 << BITS))


def mix(key: Column, seed: int) -> Column:
    """A 32-bit draw from a whole-number key by shifts and multiplications.

    Same use as ``draw`` at a small part of its cost; it compiles to plain
    arithmetic and is as easy to repeat elsewhere.
    """
    x = (key.cast("bigint").bitwiseXOR(F.shiftright(key.cast("bigint"), 32))
         .bitwiseXOR(F.lit(seed).cast("bigint")).bitwiseAND(F.lit(MASK)))
    for multiplier, shift in zip(MULTIPLIERS, (16, 15)):
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(multiplier).cast("bigint")).bitwiseAND(F.lit(MASK))
    return F.coalesce(x.bitwiseXOR(F.shiftright(x, 16)), F.lit(0).cast("bigint"))


def row_draw(df: DataFrame, row_id: str, seed: int) -> Column:
    """The draw of a row: ``mix`` for whole-number ids, ``draw`` for any other."""
    if isinstance(df.schema[row_id].dataType, WHOLE_NUMBERS):
        return mix(F.col(row_id), seed)
    return draw(F.col(row_id), F.lit(seed))
