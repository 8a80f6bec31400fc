"""The four metrics and their dispatch."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from vexel.functions import vector as v


class Metric(IntEnum):
    """Numbers are those that store files hold."""

    COSINE = 0
    EUCLIDEAN = 1
    MANHATTAN = 2
    DOT_PRODUCT = 3

    @property
    def ascending(self) -> bool:
        """Whether smaller scores are better."""
        return self is not Metric.DOT_PRODUCT

    def score(self, a: v.Vector, b: v.Vector) -> Column:
        return (v.cosine_distance, v.euclidean, v.manhattan, v.dot)[self](a, b)

    def order(self, score: Column | str = "distance") -> list[Column]:
        """Best first, NaN last."""
        score = F.col(score) if isinstance(score, str) else score
        return [F.isnan(score).asc(), score.asc() if self.ascending else score.desc()]


def distance(a: v.Vector, b: v.Vector, metric: Metric | int | Column) -> Column:
    """The score under a metric, which may be a column; 0 for a number that names none."""
    if isinstance(metric, Column):
        out = F.lit(0.0)
        for m in Metric:
            out = F.when(metric == int(m), m.score(a, b)).otherwise(out)
        return out
    return Metric(metric).score(a, b) if metric in set(Metric) else F.lit(0.0)
