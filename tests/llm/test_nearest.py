"""Nearest pairs against a comparison of all."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lavra.llm.nearest import nearest

T0 = datetime(2025, 1, 1)


def brute(left, right, tol=900):
    out = {}
    for i, e, t, *_ in left:
        fit = [(abs(u - t), u, k) for k, f, u, *_ in right if None not in (e, t, f, u, k) and e == f and abs(u - t) <= timedelta(seconds=tol)]
        if fit:
            out[i] = min(fit)[2]
    return out


def run(spark, left, right, **kw):
    schema = "id long, tag string, ts timestamp_ntz, tile string, g int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    c = (F.col("tag"), F.col("tag"))
    return {r.left_id: r.right_id for r in nearest(a, b, entity=c, ts=(F.col("ts"), F.col("ts")), ids=(F.col("id"), F.col("id")), **kw).collect()}


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"tile_s": 1800, "tile_rows": 5}), (3, {"tile_s": 60, "tile_rows": 2, "groups": 3})])
def test_equals_all_pairs(spark, seed, kw):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.03 else T0 + timedelta(seconds=rng.choice([rng.randrange(20_000), 900 * rng.randrange(22), 450 * rng.randrange(44)]))
    left = [(i, rng.choice(["A", "A", "B", None]), when(), "x", 1) for i in range(150)]
    right = [(i, rng.choice(["A", "A", "C", "B", None]), when(), "x", 1) for i in range(60)]
    assert run(spark, left, right, **kw) == brute(left, right)


def test_ties_tolerance_and_empty(spark):
    left = [(1, "A", T0, "", 0), (2, "A", T0 + timedelta(hours=5), "", 0)]
    right = [(7, "A", T0 + timedelta(seconds=900), "", 0), (9, "A", T0 - timedelta(seconds=900), "", 0), (8, "A", T0 - timedelta(seconds=900), "", 0), (6, "A", T0 + timedelta(hours=5, seconds=900, microseconds=1), "", 0)]
    assert run(spark, left, right) == {1: 8}
    assert run(spark, [], right) == {} and run(spark, left, []) == {}
