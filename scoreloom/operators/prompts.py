"""Text pairs for a pair classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scoreloom.functions.hashing import draw, uniform
from scoreloom.functions.text import (AUGMENT_TEMPLATES, BASELINE_TEMPLATE, DEFAULT_TEMPLATE,
                                      PromptTemplate)
from scoreloom.schema import ROW_ID

# Fixed value: share of training rows that get another wording.
AUGMENT_SHARE = 0.7
# template_id of the standard wording.
DEFAULT_ID = -1


def prompt_pair(df: DataFrame, template: PromptTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """Add text_a and text_b in one wording. Narrow."""
    text_a, text_b = template.columns()
    return df.withColumns({"text_a": text_a, "text_b": text_b})


def baseline_pair(df: DataFrame) -> DataFrame:
    """prompt_pair in the wording used for the untrained baseline."""
    return prompt_pair(df, BASELINE_TEMPLATE)


def augmented_pair(df: DataFrame, epochs: int = 1, seed: int = 42, row_id: str = ROW_ID,
                   share: float = AUGMENT_SHARE,
                   templates: Sequence[PromptTemplate] = AUGMENT_TEMPLATES) -> DataFrame:
    """Training pairs: each row once per epoch, some in another wording.

    Whether and how a row is reworded follows from (row_id, epoch, seed), so a
    retried task renders the same text. Rows are fanned out without a shuffle
    and only the chosen wording is rendered.
    """
    fanned = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    key = (F.col(row_id), F.col("epoch"), F.lit(seed))
    chosen = F.when(
        uniform(*key) < F.lit(share), (draw(*key, word=1) % len(templates)).cast("int")
    ).otherwise(F.lit(DEFAULT_ID))
    keyed = fanned.withColumn("template_id", chosen)
    text_a, text_b = DEFAULT_TEMPLATE.columns()
    for i, template in enumerate(templates):
        a, b = template.columns()
        picked = F.col("template_id") == i
        text_a, text_b = F.when(picked, a).otherwise(text_a), F.when(picked, b).otherwise(text_b)
    return keyed.withColumns({"text_a": text_a, "text_b": text_b})
