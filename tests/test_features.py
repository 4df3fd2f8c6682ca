"""Salted feature tables against a count by hand."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from lavra.operators import features

SCHEMA = "entity string, ts timestamp_ntz, alarm long, n string, salt int, us string"


def rows_of(n):
    rng = random.Random(3)
    return [(rng.choice(["hot", "hot", "hot", "b", None]), None if rng.random() < 0.02 else datetime(2025, 1, 1) + timedelta(hours=rng.randrange(2000)), rng.choice([7, 7, 7, 8, 3_000_000_000, None]), rng.choice(["x", None]), 1, "u") for _ in range(n)]


@pytest.mark.parametrize("salts", [1, 8])
def test_counts_recency_and_totals(spark, salts):
    rows = rows_of(1500)
    out = features.entity_features(spark.createDataFrame(rows, SCHEMA).repartition(5), ["alarm", "n"], recent_days=30, salts=salts).collect()
    sound = [r for r in rows if r[0] and r[1]]
    last = max(r[1] for r in sound)
    assert {r.entity for r in out} == {r[0] for r in sound}
    for r in out:
        assert r.alarm_ids == [7, 8, 3_000_000_000] and r.n_ids == ["x"]
        mine = [x for x in sound if x[0] == r.entity]
        total = Counter(x[2] for x in mine)
        recent = Counter(x[2] for x in mine if x[1] > last - timedelta(days=30))
        assert r.alarm_total == [total[a] for a in r.alarm_ids]
        assert r.alarm_count == [recent[a] for a in r.alarm_ids]
        assert r.alarm_recency_s == [(last - max(x[1] for x in mine if x[2] == a)).total_seconds() if total[a] else None for a in r.alarm_ids]


def test_type_without_events_and_entity_without_types(spark):
    rows = [("a", datetime(2025, 1, 1), 1, None, 0, None), ("b", datetime(2025, 1, 2), None, None, 0, None)]
    out = {r.entity: r for r in features.entity_features(spark.createDataFrame(rows, SCHEMA), ["alarm"]).collect()}
    assert out["b"].alarm_total == [0] and out["b"].alarm_recency_s == [None] and out["a"].alarm_total == [1]


def test_empty_and_many_types(spark):
    assert features.entity_features(spark.createDataFrame([], SCHEMA), ["alarm", "n"]).count() == 0
    df = spark.range(25_000).selectExpr("'a' AS entity", "timestamp_ntz'2025-01-01' AS ts", "id AS alarm")
    row = features.entity_features(df, ["alarm"]).first()
    assert row.alarm_ids == list(range(25_000)) and row.alarm_total == [1] * 25_000
