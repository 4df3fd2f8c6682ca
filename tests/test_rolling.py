"""Rolling totals against sums over every window, late arrivals and dirty input included."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lavra.operators import rolling

SCHEMA = "id long, entity string, ts timestamp_ntz, flag int, day string, batch string, amount string"


def brute(rows, periods=(7, 30)):
    per = {}
    for _, e, ts, flag, *_ in rows:
        if e is not None and ts is not None:
            n, a = per.setdefault(e, {}).get(ts.date(), (0, 0))
            per[e][ts.date()] = (n + 1, a + (flag or 0))
    out = {}
    for e, days in per.items():
        d = min(days)
        while d <= max(days):
            window = {p: [days.get(d - timedelta(k), (0, 0)) for k in range(p)] for p in periods}
            out[e, d] = (*days.get(d, (0, 0)), *[sum(x[i] for x in window[p]) for p in periods for i in (0, 1)])
            d += timedelta(1)
    return out


def run(spark, rows, batches):
    df = spark.createDataFrame(rows, SCHEMA)
    s = rolling.rolling_totals(df, F.col("entity"), F.col("ts"), F.col("flag"), F.col("id"), batches)
    return {(r.entity, r.day): (r.n_rows, r.amount, r.rows_7, r.total_7, r.rows_30, r.total_30) for r in s.collect()}, s


@pytest.mark.parametrize("batches", [1, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sums_over_every_window(spark, batches, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        e = rng.choice(["A", "A", "A", "B", "C", None])
        # mostly forward in time, some late by weeks, some before the entity's first day
        day = i // 4 + rng.choice([0, 0, 0, -3, -40, 25])
        ts = None if rng.random() < 0.02 else datetime(2025, 3, 1) + timedelta(days=day, hours=rng.randrange(24))
        rows.append((i, e, ts, rng.choice([0, 1, 1, None]), "x", "y", "z"))
    got, _ = run(spark, rows, batches)
    assert got == brute(rows)


def test_versions_recompute_only_affected_days(spark):
    rows = [(i, "A", datetime(2025, 1, 1) + timedelta(days=i), 1, None, None, None) for i in range(100)]
    daily = rolling.daily_amounts(spark.createDataFrame(rows, SCHEMA), F.col("entity"), F.col("ts"), F.col("flag"))
    v1 = rolling.advance(rolling.empty_state(daily), daily, 1)
    late = daily.where(F.col("day") == date(2025, 1, 11))
    v2 = rolling.advance(v1, late, 2).collect()
    touched = {r.day for r in v2 if r.version == 2}
    assert touched == {date(2025, 1, 11) + timedelta(k) for k in range(30)}
    assert {r.day: r.total_7 for r in v2}[date(2025, 1, 12)] == 8


def test_empty_and_null_only(spark):
    for rows in ([], [(1, None, datetime(2025, 1, 1), 1, None, None, None), (2, "A", None, 1, None, None, None)]):
        got, state = run(spark, rows, 3)
        assert got == {} and rolling.silent_after_flag(state).count() == 0


def test_silent_days(spark):
    rows = [(1, "A", datetime(2025, 1, 1), 1, None, None, None), (2, "A", datetime(2025, 1, 5), 0, None, None, None), (3, "A", datetime(2025, 3, 1), 0, None, None, None)]
    _, state = run(spark, rows, 1)
    assert sorted(r.day.day for r in rolling.silent_after_flag(state).collect()) == [2, 3, 4]


def test_two_far_corrections_rewrite_only_what_they_reach(spark, tmp_path):
    rows = [(i, e, datetime(2025, 1, 1) + timedelta(days=i), 1, None, None, None) for i in range(365) for e in "AB"]
    daily = rolling.daily_amounts(spark.createDataFrame(rows, SCHEMA), F.col("entity"), F.col("ts"), F.col("flag"))
    late = daily.where((F.col("entity") == "A") & F.col("day").isin(date(2025, 1, 5), date(2025, 12, 31)))
    want = {date(2025, 1, 5) + timedelta(k) for k in range(30)} | {date(2025, 12, 31)}
    v1 = rolling.advance(rolling.empty_state(daily), daily, 1)
    v2 = rolling.advance(v1, late, 2).collect()
    assert {(r.entity, r.day) for r in v2 if r.version == 2} == {("A", d) for d in want} and len(v2) == 730
    # the same through the store, which writes the parts that hold those days and no other
    store = rolling.RollingStore(spark, f"{tmp_path}/state")
    assert store.advance(daily) == 1
    store = rolling.RollingStore(spark, f"{tmp_path}/state")  # another run
    assert store.advance(late) == 2
    assert sorted(store.load(daily).collect()) == sorted(v2)
    written = {p for p, v in store.parts.items() if v == 2}
    assert written == {(d - date(1970, 1, 1)).days // 8 for d in want} and len(store.parts) == 46
    store.forget()
    assert sorted(rolling.RollingStore(spark, f"{tmp_path}/state").load(daily).collect()) == sorted(v2)


def test_a_version_broken_off_is_made_again(spark, tmp_path):
    rows = [(i, "A", datetime(2025, 1, 1 + i), 1, None, None, None) for i in range(20)]
    daily = rolling.daily_amounts(spark.createDataFrame(rows, SCHEMA), F.col("entity"), F.col("ts"), F.col("flag"))
    store = rolling.RollingStore(spark, f"{tmp_path}/state")
    store.advance(daily.where("day < '2025-01-11'"))
    (tmp_path / "state/data/written=2/part=1").mkdir(parents=True)  # left by a run that died
    store = rolling.RollingStore(spark, f"{tmp_path}/state")
    assert store.version == 1 and store.advance(daily.where("day >= '2025-01-11'")) == 2
    assert {(r.entity, r.day): (r.n_rows, r.amount, r.rows_7, r.total_7, r.rows_30, r.total_30) for r in store.load(daily).collect()} == brute(rows)
    with pytest.raises(RuntimeError, match="another run"):
        other = rolling.RollingStore(spark, f"{tmp_path}/state")
        other.version = 1
        other.advance(daily.where("false"))
