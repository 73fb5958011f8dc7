"""Aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both values are present.

    NULL when a side does not vary; the built-in ``corr`` stops with a division
    by zero there in ANSI mode.
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
