"""One row per entity from events of hundreds of types: two-stage salted aggregation.

The first aggregation works on (entity, types, salt), the second merges the partial statistics, then the complete type
list is expanded per entity, types without events included. The salt of a row is its input partition modulo ``salts``.
Every partition combines its own rows first, so salts add no row to the shuffle, and a group is spread over as many
tasks as there are salts, without anybody having to find out which groups are heavy: one pass over the events
does. Only the time of the last event of all is looked up before it, from two columns.

The list of types is held by the driver in one copy; every result row holds it as well.

Nulls: rows without entity or timestamp are left out; a null type has no place in the type list and counts in no type,
but its rows count in other type columns. Types of equal spelling but for outer blanks, case and accents should be made
one by the caller. Repeated rows count each. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.time import micros
from lavra.session import staged

SALTS = 16


def type_list(groups: DataFrame, column: str) -> list:
    """The sorted types of a column."""
    return sorted(r[0] for r in groups.select(column).where(F.col(column).isNotNull()).distinct().collect())


def entity_features(events: DataFrame, cols: Sequence[str], recent_days: int = 30, salts: int = SALTS) -> DataFrame:
    """One row per ``entity`` from (entity, ts, type columns ``cols``).

    For every type column ``c`` its complete list ``c_ids`` and arrays in the list's order: ``c_count`` (events in the last
    ``recent_days`` before the last event of all), ``c_recency_s`` (seconds from the type's last event to the last
    event of all, null if it has none) and ``c_total`` (events ever).
    """
    own = [f"c{i}" for i in range(len(cols))]
    events = events.select("entity", micros("ts").alias("us"), *[F.col(c).alias(o) for c, o in zip(cols, own)]).where("entity IS NOT NULL AND us IS NOT NULL")
    last = events.agg(F.max("us")).first()[0]
    floor = (last or 0) - recent_days * 86_400_000_000
    salted = events.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    recent = F.count_if(F.col("us") > floor).alias("recent")
    partial = staged(salted.groupBy("entity", *own, "salt").agg(F.count("*").alias("n"), recent, F.max("us").alias("us")), "feature-groups")
    types = [type_list(partial, o) for o in own]
    # Every type column of a partial row is a statistic of its own; the rows are few now.
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(o).cast("string").alias("type")) for i, o in enumerate(own)])
    long = partial.select("entity", "n", "recent", "us", F.explode(kinds).alias("k"))
    merged = long.groupBy("entity", "k").agg(F.sum("n").alias("n"), F.sum("recent").alias("recent"), F.max("us").alias("us"))
    entry = F.struct(F.concat_ws(":", F.col("k.kind").cast("string"), "k.type"), F.struct("n", "recent", "us"))
    wide = merged.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.when(F.col("k.type").isNotNull(), entry))).alias("m"))
    out: list[Column] = [F.col("entity")]
    for i, c in enumerate(cols):
        names = F.lit(types[i]) if types[i] else F.array().cast(f"array<{dict(partial.dtypes)[own[i]]}>")
        keys = F.lit([f"{i}:{t}" for t in types[i]]) if types[i] else F.array().cast("array<string>")

        def pick(get, keys=keys) -> Column:
            return F.transform(keys, lambda k: get(F.col("m")[k]))

        out += [
            names.alias(f"{c}_ids"),
            pick(lambda s: F.coalesce(s["recent"], F.lit(0))).alias(f"{c}_count"),
            pick(lambda s: (F.lit(last) - s["us"]) / F.lit(1e6)).alias(f"{c}_recency_s"),
            pick(lambda s: F.coalesce(s["n"], F.lit(0))).alias(f"{c}_total"),
        ]
    return wide.select(*out)
