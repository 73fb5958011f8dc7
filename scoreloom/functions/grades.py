"""Missing values and grade spelling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scoreloom.schema import NA_TOKENS

# An optionally zero-padded whole number, with or without a zero fraction.
WHOLE_NUMBER = r"^\+?0*(\d+)(?:\.0*)?$"


def null_if_missing(c: Column) -> Column:
    """NULL for a field whose text is one of the missing-value spellings."""
    return F.when(~c.isin(*NA_TOKENS), c)


def normalise_grade(c: Column) -> Column:
    """One spelling per grade: ``2``, ``2.0`` and `` 2`` all become ``2``.

    Text that is not a whole number is kept, only trimmed.
    """
    text = null_if_missing(F.trim(c.cast("string")))
    return F.regexp_replace(text, WHOLE_NUMBER, "$1")
