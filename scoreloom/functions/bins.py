"""Right-closed interval binning."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Bins:
    """Consecutive intervals ``(edge[i], edge[i+1]]`` with a label for each."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self):
        if len(self.labels) != len(self.edges) - 1:
            raise ValueError("one label per interval is needed")
        if list(self.edges) != sorted(set(self.edges)):
            raise ValueError("edges must be increasing")

    def index(self, c: Column) -> Column:
        """Bin number, NULL outside the outermost edges."""
        chosen = F.when(c <= F.lit(self.edges[0]), F.lit(None).cast("int"))
        for i, upper in enumerate(self.edges[1:]):
            inside = c.isNotNull() if math.isinf(upper) else c <= F.lit(upper)
            chosen = chosen.when(inside, F.lit(i))
        return chosen

    def label(self, index: Column) -> Column:
        return F.get(F.array(*[F.lit(x) for x in self.labels]), index)


def bands(edges: Sequence[float], labels: Sequence[str]) -> Bins:
    return Bins(tuple(float(e) for e in edges), tuple(labels))


# Edges and labels of the answer-length study.
LENGTH_BINS = bands(
    (0, 50, 100, 200, 300, 500, 1000, math.inf),
    ("0-50", "50-100", "100-200", "200-300", "300-500", "500-1000", ">1000"),
)

# Edges and labels of the length-ratio study.
RATIO_BINS = bands(
    (0, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, math.inf),
    ("0-10%", "10-25%", "25-50%", "50-75%", "75-100%", "100-150%", "150-200%", ">200%"),
)

# Names of the four length bands.
BAND_NAMES = ("Очень короткие", "Короткие", "Средние", "Длинные")
