"""Logits to class, probability, confidence and loss, per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax(logits: Column) -> Column:
    """Index of the largest value, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    """Probabilities, computed relative to the largest logit."""
    powers = bind(F.array_max(logits),
                  lambda top: F.transform(logits, lambda v: F.exp(v - top)))
    return bind(powers, lambda e: bind(
        F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
        lambda total: F.transform(e, lambda v: v / total)))


def _spread(logits: Column, top: Column) -> Column:
    """Sum of exp(v - top); at least 1, because one term is the top itself."""
    return F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))


def confidence(logits: Column) -> Column:
    """The largest softmax probability."""
    return bind(F.array_max(logits), lambda top: F.lit(1.0) / _spread(logits, top))


def negative_log_likelihood(logits: Column, label: Column) -> Column:
    """Cross-entropy of one row: log-sum-exp minus the logit of the label."""
    return bind(F.array_max(logits), lambda top: (
        F.log(_spread(logits, top)) + top - F.get(logits, label.cast("int"))))
