"""Vocabularies, pivots and encodings fitted on a training period only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vocabulary(df: DataFrame, column: str, k: int, until: Column | None = None) -> list:
    """The ``k`` most frequent values before the cut, of equals the smaller: a list of at most ``k``."""
    rows = df if until is None else df.where(until)
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return [r[0] for r in counts.orderBy(F.desc("n"), F.col(column)).limit(k).collect()]


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, prefix: str) -> DataFrame:
    """One row per key with the number of rows of each value, 0 for none; values outside the list count nowhere."""
    cols = [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*keys).agg(*cols)


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    """A column of 0 and 1 for each value; a null is 0 everywhere."""
    return df.withColumns({f"{prefix}{i}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for i, v in enumerate(values)})


def target_mean(df: DataFrame, column: str, target: str, train: Column) -> DataFrame:
    """``df`` with ``encoded``: the training mean of the target in the row's category, the mean of all for unseen and null ones."""
    fit = df.where(train).groupBy(column).agg(F.avg(target).alias("_m"))
    overall = df.where(train).agg(F.avg(target)).first()[0]
    return df.join(fit, column, "left").withColumn("encoded", F.coalesce("_m", F.lit(overall))).drop("_m")


def cyclic(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of the hour and of the weekday (Monday 0)."""
    hour, day = F.hour(ts) * F.lit(2) * F.pi() / 24, F.weekday(F.col(ts).cast("date")) * F.lit(2) * F.pi() / 7
    return df.withColumns({"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)})


def columns_by_prefix(columns: Sequence[str], include: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """The columns of a feature set: those that start with one of ``include`` but with none of ``exclude``."""
    return [c for c in columns if c.startswith(tuple(include)) and not (exclude and c.startswith(tuple(exclude)))]
