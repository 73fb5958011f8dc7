"""Lengths, previews, tokens and prompt wording."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from scoreloom.schema import QUESTION, REFERENCE, STUDENT

# A run of letters, digits, marks or underscores, or one other visible sign.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"


def tokens(c: Column) -> Column:
    """Word and punctuation tokens, case kept."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def preview(c: Column, width: int = 80) -> Column:
    """The first characters of a text, followed by dots."""
    return F.concat(F.substring(c, 1, width), F.lit("..."))


@dataclass(frozen=True)
class PromptTemplate:
    """Wording of a text pair with {question}, {reference} and {student} slots."""

    text_a: str
    text_b: str

    def columns(self) -> tuple[Column, Column]:
        return _fill(self.text_a), _fill(self.text_b)


_SLOTS = {"{question}": QUESTION, "{reference}": REFERENCE, "{student}": STUDENT}


def _fill(wording: str) -> Column:
    pieces = re.split(r"(\{question\}|\{reference\}|\{student\})", wording)
    return F.concat(*[F.col(_SLOTS[p]) if p in _SLOTS else F.lit(p) for p in pieces if p])


# Wording of the standard pair.
DEFAULT_TEMPLATE = PromptTemplate(
    "Задание: {question} Студент ответил: {student}",
    "Правильный ответ: {reference}",
)

# Wording of the pair given to the untrained baseline.
BASELINE_TEMPLATE = PromptTemplate(
    "Вопрос: {question} Ответ студента: {student}",
    "Эталонный ответ: {reference}",
)

# Wording of the seven augmentation pairs, in template order.
AUGMENT_TEMPLATES = (
    PromptTemplate("Вопрос: {question} Ответ студента: {student}",
                   "Эталонный ответ: {reference}"),
    PromptTemplate("Задание: {question} Учащийся написал: {student}",
                   "Правильный вариант: {reference}"),
    PromptTemplate("Дано задание: {question} Студент ответил: {student}",
                   "Образцовый ответ: {reference}"),
    PromptTemplate("Учебный вопрос: {question} Работа студента: {student}",
                   "Эталон: {reference}"),
    PromptTemplate("Question: {question} Student: {student}",
                   "Reference: {reference}"),
    PromptTemplate("Сравни ответ студента с эталоном. Задание: {question}",
                   "Студент: {student} | Эталон: {reference}"),
    PromptTemplate("Оцени соответствие ответа. Вопрос: {question}",
                   "Ответ студента: {student} | Правильный ответ: {reference}"),
)
