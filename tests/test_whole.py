"""Queries cover whole tables: spans beyond a month, names in any characters, all tags, long lists."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.oracle import same, views

SOURCE = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def tel(tmp, rows):
    """A folder whose tel has the given rows, all other columns null."""
    schema = pq.read_schema(f"{SOURCE}/tel.parquet")
    rows = [{"id_eventos_telemetria": i, **r} for i, r in enumerate(rows, 1)]
    pq.write_table(pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema), f"{tmp}/tel.parquet")
    return str(tmp)


def event(tag, when, **kw):
    return {"tag": tag, "data_evento": datetime.fromisoformat(when), "id_alarme": 1, "is_dont_go": 0, "id_criticidade": 1, **kw}


@pytest.fixture(scope="module")
def months(tmp_path_factory):
    rows = [event("A", "2025-01-01 01:00"), event("A", "2025-05-02 03:00"), event("A", "2025-05-02 09:00", is_dont_go=1), event("b-1", "2025-06-30 23:00")]
    return tel(tmp_path_factory.mktemp("months"), rows)


def test_samples_span_the_table(spark, months):
    rows = QUERIES["sample_grid"](spark, months).collect()
    times = {r.prediction_time for r in rows}
    assert len(rows) == 2 * len(times) == 2 * 540 and {r.tag for r in rows} == {"A", "B1"}
    assert min(r.feature_start for r in rows) == datetime(2025, 1, 1) and max(r.target_end for r in rows) == datetime(2025, 7, 1)
    assert QUERIES["gap_invalidation"](spark, months).count() == len(rows)


def test_samples_outside_february_have_features_targets_and_contexts(spark, months):
    f = QUERIES["sliding_features"](spark, months).where("n > 0").collect()
    assert sorted((r.prediction_time, r.n) for r in f if r.tag == "A") == [(datetime(2025, 1, 2), 1), *((datetime(2025, 5, 2, 8) + timedelta(hours=8 * k), n) for k, n in enumerate((1, 2, 2, 1)))]
    t = QUERIES["target_horizon"](spark, months).where("target = 1").collect()
    assert [(r.tag, r.prediction_time) for r in t] == [("A", datetime(2025, 5, 2, 8))]
    assert [tuple(r) for r in QUERIES["error_context"](spark, months).select("tag", "prediction_time", "id_alarme", "n").collect()] == [("A", datetime(2025, 5, 2, 8), 1, 1)]
    e = {(r.observa, r.horizonte): (r.amostras, r.positivas) for r in QUERIES["experiment_grid"](spark, months).collect()}
    assert e == {(8, 8): (2 * 542, 1), (8, 24): (2 * 540, 3), (24, 8): (2 * 540, 1), (24, 24): (2 * 538, 3)}


@pytest.mark.parametrize("name", ["sample_grid", "sliding_features", "target_horizon", "gap_invalidation", "error_context", "experiment_grid", "daily_coverage", "first_seen_order"])
def test_sql_on_the_fixture(spark, months, name):
    same(QUERIES[name](spark, months), views(months), SQL[name])


NAMES = ["ＭＯＴＯＲ quente", "Motor quente", " Motor quente　", "Motor​ °C", "Мотор", "Pressão do freio", "モーター"]


@pytest.fixture(scope="module")
def scripts(tmp_path_factory):
    rows = [event("A", f"2025-01-0{k} 01:00", alarme=n, id_alarme=1 if k < 4 else k) for k, n in enumerate(NAMES, 1)]
    return tel(tmp_path_factory.mktemp("scripts"), [*rows, event("A", "2025-01-08 01:00", id_alarme=9)])


def test_names_in_any_characters(spark, scripts):
    rows = {r.alarme: r for r in QUERIES["text_normalisation"](spark, scripts).collect()}
    assert {n: rows[n].conceito for n in NAMES} == dict(zip(NAMES, ["motor quente"] * 3 + ["motor c", "", "pressao do freio", ""])) and len(rows) == 8
    assert rows[NAMES[2]].sem_bordas == "Motor quente" and rows[NAMES[5]].sem_acento == "Pressao do freio"
    assert {r.conceito: (r.ids, r.menor) for r in QUERIES["text_concepts"](spark, scripts).collect()} == {"motor quente": (1, 1), "motor c": (1, 4), "": (2, 5), "pressao do freio": (1, 6), None: (1, 9)}
    assert {(r.conceito, r.familia): (r.n, r.ids) for r in QUERIES["concept_family"](spark, scripts).collect()} == {("outro", "motor"): (4, 2), ("outro", "outra"): (3, 3), ("pressao", "freio"): (1, 1)}
    assert {r.form: r["keys"] for r in QUERIES["normalisation_conflicts"](spark, scripts).collect()} == {"cru": 1, "aparado": 1, "sem_acento": 0, "conceito": 0}
    last = QUERIES["family_activity"](spark, scripts).orderBy("bin").collect()
    assert len(last) == 21 and [(r.motor_sum_9, r.freio_sum_9) for r in last][8::3] == [(3, 0), (3, 0), (2, 0), (1, 1), (0, 1)]


@pytest.mark.parametrize("name", ["text_concepts", "concept_family", "family_activity", "text_normalisation", "normalisation_conflicts"])
def test_names_in_any_characters_as_the_sql(spark, scripts, name):
    same(QUERIES[name](spark, scripts), views(scripts), SQL[name])


def test_days_of_all_tags(spark, tmp_path):
    d = tel(tmp_path, [event("A", "2025-01-01 01:00"), event(None, "2025-01-01 02:00"), event("CA70114", "2025-01-03 01:00"), event("b", "2025-01-04 01:00")])
    assert sorted((r.day.day, r.n) for r in QUERIES["daily_coverage"](spark, d).collect()) == [(1, 2), (2, 0), (3, 1), (4, 1)]


def test_more_than_ten_first_seen(spark, tmp_path):
    ids = [5, 3, 5, *range(20, 8, -1), 3]
    d = tel(tmp_path, [event("A", "2025-01-01 01:00", id_alarme=i) for i in ids])
    assert [list(r.alarmes) for r in QUERIES["first_seen_order"](spark, d).collect()] == [list(dict.fromkeys(ids))]


def test_sessions_of_errors_in_observation_and_horizon(spark, tmp_path):
    hours = ["01-31 23:59", "02-01 00:00", "02-01 00:10", "02-01 23:00", "02-02 00:00", "02-02 07:59", "02-02 08:00"]
    tel(tmp_path, [event("a-1", f"2025-{h}", is_dont_go=int(h == "02-02 07:59"), id_alarme=k // 2) for k, h in enumerate(hours)])
    p = [(1, 1, 0.1), (2, 0, 0.9), (3, 1, 0.9), (4, 0, 0.1), (5, 1, None)]
    rows = [{"sample_id": i, "tag": "A1", "prediction_time": datetime(2025, 2, 2), "target": y, "probabilidade": x} for i, y, x in p]
    schema = pq.read_schema(f"{SOURCE}/predictions.parquet")
    pq.write_table(pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema), tmp_path / "predictions.parquet")
    got = sorted((r.sample_id, r.resultado, r.parte, r.id_alarme, r.sessoes, r.eventos, r.dont_go) for r in QUERIES["error_sessions"](spark, str(tmp_path)).collect())
    # the session that begins at 23:59 before the span belongs to no sample, its second event is part of it
    one = [("horizonte", 2, 2, 2, 1), ("observacao", 1, 2, 2, 0)]
    assert got == [(i, o, *x) for i, o in ((1, "FN"), (2, "FP")) for x in one]
    same(QUERIES["error_sessions"](spark, str(tmp_path)), views(str(tmp_path)), SQL["error_sessions"])
