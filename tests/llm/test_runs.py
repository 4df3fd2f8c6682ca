"""Runs against a walk through each sequence."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lavra.llm import runs

T0 = datetime(2025, 1, 1)
SCHEMA = "id long, tag string, ts timestamp_ntz, kind long, block int, frag string, n string"


def brute(rows, gap=900):
    once = {}
    for i, tag, ts, kind, *_ in rows:
        if None not in (i, tag, ts, kind):
            once[tag, ts, kind] = min(i, once.get((tag, ts, kind), i))
    out = []
    for tag in {k[0] for k in once}:
        seq = sorted((ts, i, kind) for (t, ts, kind), i in once.items() if t == tag)
        run = []
        for e in seq:
            if run and (run[-1][2] != e[2] or (e[0] - run[-1][0]).total_seconds() > gap):
                out.append((tag, run))
                run = []
            run.append(e)
        out.append((tag, run))
    return sorted((tag, r[0][2], r[0][0], r[-1][0], len(r), min(x[1] for x in r), max(x[1] for x in r)) for tag, r in out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = runs.collapse_runs(df, F.col("tag"), F.col("ts"), F.col("kind"), F.col("id"), **kw).collect()
    for r in out:
        assert r.duration_s == (r.fim - r.inicio).total_seconds()
    return sorted((r.entity, r.kind, r.inicio, r.fim, r.n, r.id_min, r.id_max) for r in out)


@pytest.mark.parametrize("seed,block", [(1, 600), (2, 3600), (3, 60), (4, None)])
def test_runs_across_blocks(spark, seed, block):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        tag = rng.choice(["hot", "hot", "hot", "b", "c", None])
        ts = None if rng.random() < 0.01 else T0 + timedelta(seconds=rng.choice([rng.randrange(40_000), 60 * rng.randrange(600), 900 * rng.randrange(40)]))
        rows.append((rng.choice([i, i + 5000]), tag, ts, rng.choice([1, 1, 1, 2, None]), 0, "f", "n"))
    assert run(spark, rows, block_s=block) == brute(rows)


def test_gap_is_inclusive_and_ties_go_by_id(spark):
    rows = [(1, "a", T0, 1), (2, "a", T0 + timedelta(seconds=900), 1), (3, "a", T0 + timedelta(seconds=1800, microseconds=1), 1), (5, "b", T0, 1), (4, "b", T0, 2), (6, "b", T0 + timedelta(1), 1)]
    rows = [(*r, 0, "", "") for r in rows]
    assert run(spark, rows) == brute(rows)


def test_one_long_run_over_many_empty_and_full_blocks(spark):
    rows = [(1000 - i, "a", T0 + timedelta(seconds=600 * i), 7, 0, "", "") for i in range(200)]
    got = run(spark, rows, block_s=300)
    assert [(g[4], g[5], g[6]) for g in got] == [(200, 801, 1000)]


def test_copies_count_once_and_empty(spark):
    rows = [(i, "a", T0, 7, 0, "", "") for i in (9, 3, 5)]
    assert [(g[4], g[5], g[6]) for g in run(spark, rows)] == [(1, 3, 3)]
    assert run(spark, []) == []


def test_blocks_shrink_with_the_fullest_and_copies_are_combined_first(spark):
    cols = (F.col("tag"), F.col("ts"), F.col("kind"), F.col("id"))
    df = spark.createDataFrame([(i, "a", T0 + timedelta(seconds=i), 1, 0, "", "") for i in range(100)], SCHEMA)
    events, block = runs.prepared(df, *cols, rows=10)
    assert block == runs.BLOCK_SECONDS // 10 and events.count() == 100
    df = spark.createDataFrame([(i, "a", T0, 1, 0, "", "") for i in range(100)], SCHEMA)
    events, block = runs.prepared(df, *cols, rows=10)
    assert block == runs.BLOCK_SECONDS and [r.id for r in events.collect()] == [0]
