"""Audits of an event log and of state intervals. Every function is one or two aggregations of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.stats import quantile


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls): the nulls of every column in one pass, turned into rows."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "nulls")


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, violations): the rows in which each rule is violated (a null rule isn't)."""
    one = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return one.unpivot([], list(rules), "check", "violations")


def tuple_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct tuples (nulls kept) and their difference."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("tuples")).withColumn("surplus", F.col("rows") - F.col("tuples"))


def conflicts(df: DataFrame, key: str | Column, value: str | Column) -> DataFrame:
    """Keys that go with more than one value, with the sorted values."""
    pairs = df.select((F.col(key) if isinstance(key, str) else key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value")).distinct()
    return pairs.groupBy("key").agg(F.count("value").alias("n"), F.sort_array(F.collect_list("value")).alias("values")).where("n > 1")


def conflicts_by_form(df: DataFrame, key: str, forms: dict[str, Column]) -> DataFrame:
    """(form, keys): how many keys go with more than one value under each normal form of the value."""
    spread = df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("form"), c.alias("value")) for n, c in forms.items()])).alias("f")).select(key, "f.*").distinct()
    per = spread.groupBy("form", key).agg(F.count("value").alias("n"))
    return per.groupBy("form").agg(F.count_if(F.col("n") > 1).alias("keys"))


def daily_coverage(df: DataFrame, ts: str) -> DataFrame:
    """(day, n): rows of every day from the first to the last, 0 for missing ones."""
    per = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    span = per.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo IS NOT NULL")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("day")).join(per, "day", "left").na.fill(0, ["n"])


def volume_anomalies(df: DataFrame, entity: str, ts: str, factor: float = 10.0) -> DataFrame:
    """Entity days with more rows than the median plus ``factor`` median absolute deviations (one row at least)."""
    per = df.where(F.col(ts).isNotNull() & F.col(entity).isNotNull()).groupBy(entity, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    med = per.groupBy(entity).agg(F.percentile("n", F.lit(0.5)).alias("median"))
    dev = per.join(med, entity).groupBy(entity).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col("n") - F.col("median")), F.lit(0.5)).alias("mad"))
    return per.join(dev, entity).where(F.col("n") > F.col("median") + F.lit(factor) * F.greatest(F.col("mad"), F.lit(1.0)))


def dominant_signal(df: DataFrame, entity: str, ts: str, kind: str, days: DataFrame) -> DataFrame:
    """For each of ``days`` (entity, day) its most frequent kind, that kind's share and the share of distinct times."""
    rows = df.withColumn("day", F.to_date(ts)).join(days.select(entity, "day"), [entity, "day"])
    per = rows.groupBy(entity, "day", kind).agg(F.count("*").alias("n"))
    times = rows.groupBy(entity, "day", ts).agg(F.count("*").alias("k")).groupBy(entity, "day").agg(F.count("*").alias("times"))
    w = Window.partitionBy(entity, "day")
    top = per.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), F.col(kind)))).where("rn = 1")
    return top.join(times, [entity, "day"]).select(entity, "day", kind, "n", "total", (F.col("n") / F.col("total")).alias("kind_share"), (F.col("times") / F.col("total")).alias("time_share"))


def contract(dictionary: DataFrame, name: str, table: str, actual: dict[str, Sequence[str]]) -> DataFrame:
    """(table, column, where): columns the dictionary names but the table lacks ('missing'), and the other way round ('extra')."""
    spark = dictionary.sparkSession
    have = spark.createDataFrame([(t, c) for t, cols in actual.items() for c in cols], "`table` string, `column` string")
    said = dictionary.select(F.lower(F.trim(table)).alias("table"), F.lower(F.trim(name)).alias("column")).where("`column` IS NOT NULL").distinct()
    said = said.where(F.col("table").isin(list(actual)))
    missing = said.join(have, ["table", "column"], "left_anti").withColumn("where", F.lit("missing"))
    return missing.unionByName(have.join(said, ["table", "column"], "left_anti").withColumn("where", F.lit("extra")))


def day_against_history(df: DataFrame, ts: str, day: str) -> DataFrame:
    """The rows of one day over the median, the 95th percentile and the largest of the other days."""
    per = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("d")).agg(F.count("*").alias("n"))
    target = F.expr(f"date'{day}'")
    n = F.coalesce(F.max(F.when(F.col("d") == target, F.col("n"))), F.lit(0))
    other = F.when(F.col("d") != target, F.col("n"))
    stats = per.agg(n.alias("n"), F.percentile(other, F.lit(0.5)).alias("median"), F.percentile(other, F.lit(0.95)).alias("p95"), F.max(other).alias("max"))
    return stats.select("n", *[F.try_divide(F.col("n"), F.col(c)).alias(f"over_{c}") for c in ("median", "p95", "max")])


def context_conflicts(df: DataFrame, keys: Sequence[str], context: Sequence[str], ts: str, hours: Sequence[int]) -> DataFrame:
    """Groups of equal ``keys`` whose context differs, and how many of them lie in the given hours."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*context)).alias("contexts")).where("contexts > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.hour(ts).isin(list(hours))).alias("in_hours"))


def mode_per_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equals the smallest."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(value))
    return per.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def coverage_by_top(counts: DataFrame, n: str, tie: str, tops: Sequence[int]) -> DataFrame:
    """(top, share): the share of all that the ``top`` largest counts hold, for each number of ``tops``.

    Only the largest ``max(tops)`` rows are ever ordered.
    """
    largest = counts.orderBy(F.desc(n), F.col(tie)).limit(max(tops))
    ranked = largest.withColumn("rn", F.row_number().over(Window.orderBy(F.desc(n), F.col(tie))))
    total = counts.agg(F.sum(n)).first()[0]
    one = ranked.agg(*[F.sum(F.when(F.col("rn") <= t, F.col(n))).alias(f"t{t}") for t in tops])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("top"), (F.col(f"t{t}") / F.lit(total)).alias("share")) for t in tops])))


def robust_scores(df: DataFrame, keys: Sequence[str], value: str, accuracy: int | None = None) -> DataFrame:
    """``df`` with ``z``: the value's distance from its group's median in median absolute deviations (1 at least).

    Two aggregations and two joins by group; a stand-in for isolation forests, which Spark lacks.
    """
    med = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(quantile(value, 0.5, accuracy).alias("_med"))
    off = df.join(med, list(keys), "left")
    mad = off.where(F.col(value).isNotNull()).groupBy(*keys).agg(quantile(F.abs(F.col(value) - F.col("_med")), 0.5, accuracy).alias("_mad"))
    return off.join(mad, list(keys), "left").withColumn("z", (F.col(value) - F.col("_med")) / F.greatest(F.col("_mad"), F.lit(1.0))).drop("_med", "_mad")
