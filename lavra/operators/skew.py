"""Per-key work when a few keys hold most rows: exact offset chunking.

1. Count the keys of each input partition (combined before the shuffle).
2. Prefix-sum the counts of each key over the partitions: the number of the key's first row in every partition.
3. Number the rows: a row's number is its partition's offset plus its place among the key's rows in that partition.
4. A chunk is ``chunk_rows`` consecutive numbers of one key. Chunks, not keys, are the unit of work, so no piece of
   the work is larger than a chunk, however many rows its key holds.
5. Each chunk gives one partial state with its first and last row; the states of a key, in chunk order, are merged.

Rows are shuffled once, by input partition and key, a group no larger than an input partition. The windows over a whole
key run over one row per input partition (step 2) or per chunk (step 5). The input partition of a row and its place
there come from one numbering of the scan, which both uses repeat; so an input whose rows could come in another order the
second time (anything but a scan with projections and filters) is first written to the shared folder.

Nulls: a null in a key is a key of its own. Empty input gives an empty result. Ties do not occur, rows are numbered in
input order. Extra columns are ignored unless named; names starting with ``_lv_`` are the operator's own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.session import staged

CHUNK_ROWS = 100_000


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


#: Logical nodes that keep the rows of a scan in their partitions and order.
_STEADY = {"Project", "Filter", "Relation", "LogicalRelation", "LocalRelation", "Range", "RelationV2", "ColumnarToRow"}


def steady(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is a scan with projections and filters, else its rows as a table in the shared folder."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-]*(\w+)", line))}
    return df if nodes <= _STEADY else staged(df, name)


def number_rows(df: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with ``_lv_no`` (0, 1, 2, ... within its key, in input order, without gaps) and ``_lv_chunk``."""
    keys = list(keys)
    df = steady(df, "numbering")
    placed = df.withColumn("_lv_pos", F.monotonically_increasing_id()).withColumn("_lv_part", F.shiftright("_lv_pos", 33))
    counts = placed.groupBy("_lv_part", *keys).agg(F.count("*").alias("_lv_n"))
    before = Window.partitionBy(*keys).orderBy("_lv_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_lv_offset", F.coalesce(F.sum("_lv_n").over(before), F.lit(0))).drop("_lv_n")
    here = Window.partitionBy("_lv_part", *keys).orderBy("_lv_pos")
    local = placed.withColumn("_lv_local", F.row_number().over(here) - 1)
    out = local.alias("r").join(offsets.alias("o"), (F.col("r._lv_part") == F.col("o._lv_part")) & _same("r", "o", keys))
    number = F.col("_lv_offset") + F.col("_lv_local")
    return out.select("r.*", number.alias("_lv_no")).drop("_lv_pos", "_lv_part", "_lv_local").withColumn("_lv_chunk", F.floor(F.col("_lv_no") / F.lit(chunk_rows)))


def chunk_states(numbered: DataFrame, keys: Sequence[str], aggregates: Sequence[Column] = (), track: str | None = None) -> DataFrame:
    """One partial state per key and chunk: rows, numbers of the first and last row, ``aggregates``, and for ``track``
    its values at both ends and the number of changes between neighbours inside the chunk."""
    aggregates = list(aggregates)
    group = [*keys, "_lv_chunk"]
    if track:
        w = Window.partitionBy(*group).orderBy("_lv_no")
        prev, first = F.lag(track).over(w), F.row_number().over(w) == 1
        numbered = numbered.withColumn("_lv_change", (~first & ~prev.eqNullSafe(F.col(track))).cast("long"))
        ends = F.struct("_lv_no", F.col(track).alias("v"))
        aggregates += [F.sum("_lv_change").alias("_lv_changes"), F.min(ends).alias("_lv_head"), F.max(ends).alias("_lv_tail")]
    return numbered.groupBy(*group).agg(F.count("*").alias("_lv_rows"), F.min("_lv_no").alias("_lv_first"), F.max("_lv_no").alias("_lv_last"), *aggregates)


def merge_states(states: DataFrame, keys: Sequence[str], merges: Sequence[Column] = (), track: bool = False) -> DataFrame:
    """The states of every key merged in chunk order: ``n``, ``chunks``, ``whole`` (no number missing or twice at any
    chunk border), ``merges``, and for a tracked column the changes within chunks and across their borders."""
    w = Window.partitionBy(*keys).orderBy("_lv_chunk")
    ok = (F.col("_lv_first") == F.coalesce(F.lag("_lv_last").over(w) + 1, F.lit(0))) & (F.col("_lv_last") - F.col("_lv_first") + 1 == F.col("_lv_rows"))
    states = states.withColumn("_lv_ok", ok)
    merges = list(merges)
    if track:
        prev = F.lag("_lv_tail").over(w)
        across = F.when(prev.isNotNull() & ~prev["v"].eqNullSafe(F.col("_lv_head.v")), 1).otherwise(0)
        states = states.withColumn("_lv_across", across)
        merges.append(F.sum(F.col("_lv_changes") + F.col("_lv_across")).alias("changes"))
    return states.groupBy(*keys).agg(F.sum("_lv_rows").alias("n"), F.count("*").alias("chunks"), F.bool_and("_lv_ok").alias("whole"), *merges)


def chunked_counts(df: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, n, chunks, whole): the complete count of every key, from equal-sized chunks."""
    numbered = number_rows(df.select(*keys), keys, chunk_rows)
    return merge_states(chunk_states(numbered, keys), keys)
