"""All registered queries; importing this module registers them."""

from __future__ import annotations

from scoreloom.plans import comparison, evaluation, length_study, models, served, sketched, tables  # noqa: F401
from scoreloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
