"""Streams in several batches against the closed table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lavra import streaming
from lavra.operators import events
from lavra.streaming import pipelines

T0 = datetime(2025, 1, 1)
SCHEMA = "id long, tag string, ts timestamp_ntz, v int"
ROWS = [
    [(1, "A", T0, 1), (2, "A", T0 + timedelta(minutes=5), 2), (3, "B", T0, 3)],
    [(4, "A", T0 + timedelta(minutes=5), 2), (5, "A", T0 + timedelta(minutes=25), 4), (6, "B", T0 + timedelta(hours=3), 5)],
    [(7, "A", T0 + timedelta(minutes=1), 6), (8, "C", T0 + timedelta(hours=9), 7), (9, None, T0 + timedelta(hours=9), 8)],
]


@pytest.fixture()
def folder(spark, tmp_path):
    for i, rows in enumerate(ROWS):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    return str(tmp_path)


def test_duplicates_across_batches(spark, folder):
    s = streaming.deduplicated(streaming.read_stream(spark, folder, "t", 1), "ts", ["tag", "ts"])
    out = streaming.run_available(s.select("tag", "ts"), "dedup")
    assert out.count() == 8 and out.distinct().count() == 8


def test_windows_across_batches(spark, folder):
    s = streaming.windowed(streaming.read_stream(spark, folder, "t", 1), "ts", ["tag"], "1 hour", None, {"n": F.count("*"), "v": F.sum("v")})
    got = sorted((r.tag or "", r.start, r.n, r.v) for r in streaming.run_available(s, "win", "complete").collect())
    assert got == [("", T0 + timedelta(hours=9), 1, 8), ("A", T0, 5, 15), ("B", T0, 1, 3), ("B", T0 + timedelta(hours=3), 1, 5), ("C", T0 + timedelta(hours=9), 1, 7)]


def test_sessions_equal_the_batch_operator(spark, folder):
    s = streaming.sessions(streaming.read_stream(spark, folder, "t", 1).where("tag IS NOT NULL"), "ts", ["tag"], "10 minutes")
    got = sorted((r.tag, r.first, r.last, r.n) for r in streaming.run_available(s, "ses", "complete").collect())
    want = events.sessions(spark.read.parquet(f"{folder}/t.parquet"), ["tag"], "ts", 600).collect()
    assert got == sorted((r.tag, r.start, r.end, r.n) for r in want)


def test_enrichment_keeps_unmatched_rows(spark, folder):
    states = spark.createDataFrame([("A", T0, T0 + timedelta(minutes=10), "op"), ("B", T0 + timedelta(hours=3), T0, "bad")], "tag string, a timestamp_ntz, b timestamp_ntz, state string")
    s = streaming.enriched(streaming.read_stream(spark, folder, "t", 2), states, "tag", "ts", "a", "b", ["state"])
    got = {r.id: r.state for r in streaming.run_available(s.select("id", "state"), "enr").collect()}
    assert got == {1: "op", 2: "op", 3: None, 4: "op", 5: None, 6: None, 7: "op", 8: None, 9: None}


def test_updates_give_what_complete_batches_give(spark, folder):
    made = lambda: streaming.windowed(streaming.read_stream(spark, folder, "t", 1), "ts", ["tag"], "1 hour", "30 minutes", {"n": F.count("*"), "v": F.sum("v")})
    got = streaming.run_available(made(), "upd", "update", keys=["tag", "start", "end"]).collect()
    want = streaming.run_available(made(), "com", "complete").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 10


def test_closed_sessions_equal_the_batch_operator(spark, folder):
    source = streaming.read_stream(spark, folder, "t", 1)
    out = streaming.run_closed(source, "ts", "closed", lambda s: streaming.sessions(s.where("tag IS NOT NULL OR ts > '9000-01-01'"), "ts", ["tag"], "10 minutes"))
    want = events.sessions(spark.read.parquet(f"{folder}/t.parquet"), ["tag"], "ts", 600).collect()
    assert sorted((r.tag, r.first, r.last, r.n) for r in out.collect()) == sorted((r.tag, r.start, r.end, r.n) for r in want)


def test_a_batch_tried_again_replaces_itself(spark, tmp_path):
    write = pipelines._sink(str(tmp_path), None)
    for rows in (3, 5):  # the first try was broken off
        write(spark.range(rows), 0)
    write(spark.range(2), 1)
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").count() == 7
