"""Edge semantics of the core operators, on fixtures cut by hand and generated ones."""

import random
from datetime import date, datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavra.functions.text import plain_key, strip_accents, strip_outer, text_concept
from lavra.functions.time import seconds_between
from lavra.operators import chained, concepts, encoding, evaluation, events, grid, intervals, quality
from lavra.sources import calendar

T0 = datetime(2025, 1, 1)


def at(**kw):
    return T0 + timedelta(**kw)


def test_session_gap_is_strict_in_milliseconds(spark):
    rows = [(1, "A", at()), (2, "A", at(seconds=60)), (3, "A", at(seconds=120, milliseconds=1)), (4, "A", at(seconds=120, milliseconds=1))]
    out = events.sessions(spark.createDataFrame(rows, "id long, tag string, ts timestamp_ntz"), ["tag"], "ts", 60, sums={"ids": F.col("id")}).orderBy("session").collect()
    assert [(r.n, r.duration_ms, r.ids) for r in out] == [(2, 60_000, 3), (2, 0, 7)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 400_000)), max_size=60))
def test_sessions_equal_the_curve_and_shrink_with_the_gap(spark, rows):
    df = spark.createDataFrame([(i, k, at(seconds=s)) for i, (k, s) in enumerate(rows)], "id long, tag string, ts timestamp_ntz")
    curve = {r.gap_s: r.sessions for r in events.sessions_by_gap(df, ["tag"], "ts", [60, 3600, 86400]).collect()}
    assert curve[60] >= curve[3600] >= curve[86400]
    s = events.sessions(df, ["tag"], "ts", 3600)
    assert s.count() == curve[3600] and sum(r.n for r in s.collect()) == len(rows)


def test_gaps_by_rows_and_by_instants(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("AB"), at(minutes=rng.choice([0, 0, 0, rng.randrange(5000)]))) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "id long, tag string, ts timestamp_ntz")
    want, last = {}, {}
    for i, tag, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = (ts - last[tag]) // timedelta(milliseconds=1) if tag in last else None
        last[tag] = ts
    for limit in (500_000, 10):
        assert {r.id: r.gap_ms for r in events.gaps(df, ["tag"], "ts", "id", block_rows=limit).collect()} == want


def test_blocks_give_the_plain_window(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["A", "B", None]), at(minutes=rng.randrange(20_000)), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, tag string, ts timestamp_ntz, v int").withColumn("b", chained.block_of("ts", 7200))
    got = chained.with_running_sum(chained.with_previous(df, ["tag"], "b", ["ts", "id"], ["v"]), ["tag"], "b", ["ts", "id"], "v", "run")
    got = {r.id: (r.prev_v, r.run) for r in got.collect()}
    want, last, run = {}, {}, {}
    for i, tag, ts, v in sorted(rows, key=lambda r: (r[2], r[0])):
        run[tag] = run.get(tag, 0) + v
        want[i] = (last.get(tag), run[tag])
        last[tag] = v
    assert got == want


def test_dedup_keeps_rows_and_nulls_equal(spark):
    rows = [(3, "A", None), (1, "A", None), (2, "A", 1.0), (4, "B", None)]
    df = spark.createDataFrame(rows, "id long, tag string, v double")
    out = events.deduplicated(df, "id", ["tag", "v"], F.col("tag") == "B").collect()
    assert sorted((r.id, r.copies) for r in out) == [(1, 2), (2, 1)]
    assert events.duplicate_statistics(df, ["tag", "v"]).first()[:] == (1, 2, 1)


def intervals_df(spark):
    rows = [("A", at(), at(hours=2), "op", 1), ("A", at(hours=1), at(hours=30), "stop", 2), ("A", at(hours=5), at(hours=5), "op", 3), ("A", at(hours=9), at(hours=8), "op", 4), ("A", None, at(), "op", 5), ("B", at(), None, "op", 6)]
    return spark.createDataFrame(rows, "tag string, s timestamp_ntz, e timestamp_ntz, state string, iid long")


def test_points_in_half_open_intervals(spark):
    ev = spark.createDataFrame([(1, "A", at()), (2, "A", at(hours=2)), (3, "A", at(hours=1, minutes=30)), (4, "B", at()), (5, "A", at(hours=30))], "id long, tag string, ts timestamp_ntz")
    out = intervals.point_in_interval(ev, intervals_df(spark), "tag", "ts", "s", "e", ["state"]).collect()
    got = sorted((r.id, r.state or "") for r in out)
    assert got == [(1, "op"), (2, "stop"), (3, "op"), (3, "stop"), (4, ""), (5, "")]


def test_clipped_overlaps_and_shares(spark):
    w = spark.createDataFrame([("A", at(), at(hours=8)), ("A", at(hours=40), at(hours=48)), ("B", at(), at(hours=8))], "tag string, a timestamp_ntz, b timestamp_ntz")
    out = {(r.tag, r.a): r for r in intervals.state_shares(w, intervals_df(spark), "tag", ("a", "b"), ("s", "e"), "state", ["op", "stop"]).collect()}
    r = out["A", T0]
    assert (r.share_0, r.share_1, r.covered, r.doubled, r.dominant) == (0.25, 0.875, 1.0, 0.125, "stop")
    assert out["A", at(hours=40)].dominant is None and out["B", T0].covered == 0.0


def test_asof_both_ways_equal_times_and_blocks(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("AB"), at(minutes=rng.randrange(8000))) for i in range(200)]
    right = [(i, rng.choice("AC"), at(minutes=rng.randrange(8000))) for i in range(40)]
    ldf, rdf = (spark.createDataFrame(x, "id long, tag string, ts timestamp_ntz") for x in (left, right))
    for direction in ("forward", "backward"):
        for exact in (True, False):
            rows = 500_000 if exact else 1  # the second way: instants matched once
            out = intervals.asof(ldf, rdf, "tag", "ts", "ts", "id", direction, exact, tolerance_s=86_400 * 2, seconds=7200, block_rows=rows)
            got = {r.id: (r.match_ts, r.match_id) for r in out.collect()}
            assert len(got) == len(left)
            for i, tag, ts in left:
                fit = [(t, k) for k, e, t in right if e == tag and ((t > ts if direction == "forward" else t < ts) or (exact and t == ts)) and abs(t - ts) <= timedelta(days=2)]
                t = (min if direction == "forward" else max)((x[0] for x in fit), default=None)
                assert got[i] == (t, min((k for u, k in fit if u == t), default=None))


def test_previous_interval_only(spark):
    out = intervals.overlaps_with_previous(intervals_df(spark), "tag", "s", "e", "iid", "state").collect()
    assert {(r.iid, r.prev_iid) for r in out} == {(2, 1), (3, 2)}


def test_grids_and_leak_guard(spark):
    df = spark.createDataFrame([("A", at(hours=1)), ("A", at(hours=17)), ("A", None), (None, at())], "tag string, ts timestamp_ntz")
    bins = grid.dense(grid.tumbling(df, "tag", "ts", 8 * 3600, [F.count("*").alias("n")]), "tag", 8 * 3600, ["n"])
    assert [r.n for r in bins.orderBy("bin").collect()] == [1, 0, 1]
    t = grid.trailing(bins, "tag", ["n"], [3]).orderBy("bin").collect()
    assert [(r.n_sum_3, r.n_mean_3) for r in t] == [(1, 1.0), (1, 0.5)]
    a = grid.acceleration(bins, "tag", "n", 3).orderBy("bin").collect()
    assert [round(r.n_accel, 6) for r in a] == [1.0, 0.0, 1.5]
    assert grid.tumbling(df.where("false"), "tag", "ts", 60, [F.count("*").alias("n")]).count() == 0


def test_samples_never_see_their_own_time(spark):
    ev = spark.createDataFrame([("A", at(hours=7)), ("A", at(hours=8)), ("A", at(hours=16))], "tag string, ts timestamp_ntz")
    s = grid.sample_grid(ev, "tag", "2025-01-01 08:00:00", "2025-01-01 16:00:00", 8 * 3600, 24 * 3600, 8 * 3600)
    bins = grid.tumbling(ev, "tag", "ts", 8 * 3600, [F.count("*").alias("n")])
    f = grid.horizon_target(grid.sliding(s, bins, "tag", 8 * 3600, 24 * 3600, ["n"]), ev, "tag", "ts", 8 * 3600, 8 * 3600)
    assert sorted((r.prediction_time.hour, r.n, r.target) for r in f.collect()) == [(8, 1, 1), (16, 2, 1)]
    ids = grid.with_sample_ids(s, "tag").orderBy("sample_id").collect()
    assert [(r.sample_id, r.prediction_time.hour) for r in ids] == [(1, 8), (2, 16)]
    v = grid.outside(s, [("2025-01-02 00:00:00", "2025-01-03 00:00:00")]).collect()
    assert all(r.valid for r in v)  # the last target ends where the outage begins
    split = grid.chronological_split(s, "prediction_time", [("train", "2025-01-01 16:00:00")], "test").collect()
    assert sorted(r.split for r in split) == ["test", "train"]


def test_text_keys(spark):
    df = spark.createDataFrame([(" pe-4105\n",), ("(PE 4105)",), ("--",), (None,), ("ÁÉ ção (L-1850)",)], "x string")
    assert [r[0] for r in df.select(plain_key("x")).collect()][:4] == ["PE4105", "PE4105", None, None]
    r = df.select(strip_accents("x"), strip_outer("x"), text_concept("x")).collect()
    assert r[4][0] == "AE cao (L-1850)" and r[0][1] == "pe-4105" and r[4][2] == "ae cao" and r[3][:] == (None, None, None)


def test_second_borders(spark):
    df = spark.createDataFrame([(at(milliseconds=900), at(milliseconds=1100))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(seconds_between("a", "b")).first()[0] == 1
    assert calendar(spark, "timestamp_ntz'2025-01-01'", "timestamp_ntz'2025-01-02'", "8 hours").count() == 4


def scored(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 1, None]), rng.choice([0.0, 0.1, 0.25, 0.5, 0.5, 0.9, 1.0, None]), rng.choice("xy")) for _ in range(300)] + [(0, 0.3, "z")]
    return [r for r in rows if r[0] is not None and r[1] is not None], spark.createDataFrame(rows, "y int, p double, g string")


def test_sweep_equals_direct_counts(spark):
    rows, df = scored(spark)
    for r in evaluation.sweep(df, "y", "p", [0.1, 0.3, 0.5, 1.0], ["g"]).collect():
        mine = [x for x in rows if x[2] == r.g]
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(sum((x[1] >= r.threshold) == a and x[0] == b for x in mine) for a, b in ((True, 1), (True, 0), (False, 1), (False, 0)))
    z = [r for r in evaluation.at_threshold(df, "y", "p", 0.9, ["g"]).collect() if r.g == "z"][0]
    assert (z.precision, z.recall, z.f2) == (0.0, 0.0, 0.0)


def test_curves_with_ties(spark):
    rows, df = scored(spark)
    auc = {r.g: r.roc_auc for r in evaluation.roc_auc(df, "y", "p", ["g"]).collect()}
    ap = {r.g: r.average_precision for r in evaluation.average_precision(df, "y", "p", ["g"]).collect()}
    assert auc["z"] is None and ap["z"] == 0.0
    for g in "xy":
        pos, neg = ([x[1] for x in rows if x[2] == g and x[0] == k] for k in (1, 0))
        assert abs(auc[g] - sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) < 1e-12
        total, tp, n = 0.0, 0, 0
        for s in sorted({x[1] for x in rows if x[2] == g}, reverse=True):
            here = [x for x in rows if x[2] == g and x[1] == s]
            tp, n = tp + sum(x[0] for x in here), n + len(here)
            total += sum(x[0] for x in here) / len(pos) * tp / n
        assert abs(ap[g] - total) < 1e-12


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.1000001, 0.3, 1.0)], "p double")
    assert [r[0] for r in df.select(evaluation.probability_bin("p")).collect()] == [0, 0, 1, 2, 9]


def test_audits(spark):
    df = spark.createDataFrame([(1, "a", at()), (1, "b", at(days=2)), (2, "a", None), (None, None, at())], "k int, v string, ts timestamp_ntz")
    assert {r.column: r.nulls for r in quality.null_profile(df).collect()} == {"k": 1, "v": 1, "ts": 1}
    assert [(r.key, r["values"]) for r in quality.conflicts(df, "k", "v").collect()] == [(1, ["a", "b"])]
    assert sorted((r.day, r.n) for r in quality.daily_coverage(df, "ts").collect()) == [(date(2025, 1, 1), 2), (date(2025, 1, 2), 0), (date(2025, 1, 3), 1)]
    assert quality.daily_coverage(df.where("false"), "ts").count() == 0
    assert quality.tuple_distinct(df, ["k", "v"]).first()[:] == (4, 4, 0)


def test_vocabulary_looks_at_training_only(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, 1), (3, 1), (3, 1), (None, 0)], "a int, later int")
    assert encoding.vocabulary(df, "a", 5, F.col("later") == 0) == [2, 1]
    assert encoding.columns_by_prefix(["alarm_1", "alarm_x", "target"], ["alarm_"], ["alarm_x"]) == ["alarm_1"]


def test_similar_pairs_lose_none(spark):
    from difflib import SequenceMatcher

    rng = random.Random(6)
    base = ["engine oil pressure low", "motor de tração 2", "abc", "ab", ""]
    names = sorted({"".join(c for c in b if rng.random() > 0.15) for b in base for _ in range(12)})
    got = {(r.a, r.b) for r in concepts.similar_pairs(spark.createDataFrame([(n,) for n in names] + [(None,)], "n string"), "n").collect()}
    want = {(a, b) for a in names for b in names if a < b and SequenceMatcher(None, a, b).ratio() >= 0.75}
    assert got == want
