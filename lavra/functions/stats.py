"""Quantiles, exact or from a sketch of bounded size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile(c: Column | str, q: float, accuracy: int | None = None) -> Column:
    """The interpolated quantile. An exact one keeps every distinct value of a group; with ``accuracy`` a sketch is kept
    instead, off by at most 1 / accuracy in rank, for groups of more values than a task should hold."""
    c = F.col(c) if isinstance(c, str) else c
    return F.percentile(c, F.lit(q)) if accuracy is None else F.percentile_approx(c, q, accuracy)
