"""Windows over long sequences, cut into blocks.

``lag`` or a running sum over a whole entity puts the entity's rows into one task. Here the window runs over blocks (the
entity's rows of one stretch of time) and one row per block carries what the next block needs. The result equals the
plain window's; the largest piece of work is a block, not an entity.

Nulls: entities may be null (a key of their own); rows with a null block must be left out before. Ties are ordered by
the given order columns, which have to be unique within an entity. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.time import micros

BLOCK_SECONDS = 86_400


def block_of(ts: Column | str, seconds: int = BLOCK_SECONDS) -> Column:
    """The number of the stretch of time that holds the timestamp."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def _join_blocks(df: DataFrame, blocks: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    names = {c: f"_lv_k{i}" for i, c in enumerate([*keys, block])}
    blocks = blocks.withColumnsRenamed(names)
    on = F.col(block) == F.col(names[block])
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(names[k]))
    return df.join(blocks, on).drop(*names.values())


def with_previous(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """``df`` with ``prev_c`` for each of ``cols``: the value in the row before, in the entity's order."""
    fields = [*order, *[c for c in cols if c not in order]]
    blocks = df.groupBy(*keys, block).agg(F.max(F.struct(*fields)).alias("_lv_tail"))
    chain = Window.partitionBy(*keys).orderBy(block)
    blocks = blocks.withColumn("_lv_before", F.lag("_lv_tail").over(chain)).drop("_lv_tail")
    w = Window.partitionBy(*keys, block).orderBy(*order)
    out = df.withColumn("_lv_local", F.lag(F.struct(*fields)).over(w))
    out = _join_blocks(out, blocks, keys, block)
    prev = F.coalesce("_lv_local", "_lv_before")
    return out.withColumn("_lv_prev", prev).select(*df.columns, *[F.col(f"_lv_prev.{c}").alias(f"{prefix}{c}") for c in cols])


def with_running_sum(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the entity's rows up to and with this one."""
    blocks = df.groupBy(*keys, block).agg(F.sum(value).alias("_lv_sum"))
    chain = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_lv_offset", F.coalesce(F.sum("_lv_sum").over(chain), F.lit(0))).drop("_lv_sum")
    w = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_lv_local", F.sum(value).over(w))
    out = _join_blocks(out, blocks, keys, block)
    return out.select(*df.columns, (F.col("_lv_offset") + F.col("_lv_local")).alias(name))
