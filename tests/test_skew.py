"""Offset chunking: complete counts, exact numbers, states that fit together."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lavra.operators import skew


def frame(spark, n=3000, parts=7):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([1, 1, 2, None]), rng.choice("xyz"), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "tag string, kind long, v string, _lv_extra int").repartition(parts)


def test_counts_are_complete(spark):
    rows, df = frame(spark)
    got = {(r.tag, r.kind): (r.n, r.chunks, r.whole) for r in skew.chunked_counts(df, ["tag", "kind"], 100).collect()}
    want = Counter((r[0], r[1]) for r in rows)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[2] and v[1] == -(-v[0] // 100) for v in got.values())


def test_numbers_have_no_gap_and_chunks_are_equal(spark):
    _, df = frame(spark)
    numbered = skew.number_rows(df, ["tag"], 250)
    for tag, n in Counter(r.tag for r in df.collect()).items():
        mine = numbered.where(F.col("tag").eqNullSafe(F.lit(tag))).collect()
        assert sorted(r._lv_no for r in mine) == list(range(n))
    assert max(r["count"] for r in numbered.groupBy("tag", "_lv_chunk").count().collect()) == 250


def test_changes_across_chunk_borders(spark):
    rows = [("k", "aabbbca"[i % 7]) for i in range(1000)]
    df = spark.createDataFrame(rows, "tag string, v string").coalesce(1)
    numbered = skew.number_rows(df, ["tag"], 33)
    out = skew.merge_states(skew.chunk_states(numbered, ["tag"], track="v"), ["tag"], track=True).collect()
    assert out[0].changes == sum(rows[i][1] != rows[i - 1][1] for i in range(1, 1000)) and out[0].whole


def test_empty(spark):
    assert skew.chunked_counts(spark.createDataFrame([], "tag string, kind long"), ["tag", "kind"]).count() == 0
