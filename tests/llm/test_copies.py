"""Copies hidden by formatting against a comparison of canonical forms."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavra.functions.time import micros
from lavra.llm import copies
from lavra.llm.plan_copies import FIELDS

text = st.text(alphabet=st.sampled_from(list("abAB01 .-_é É –ßİ日")), max_size=12)


def canonical(s):
    return "".join(copies.fold_char(c) for c in s)


@settings(max_examples=200, deadline=None)
@given(text, text)
def test_two_pointers_equal_canonical_forms(a, b):
    assert copies.same_folded(a, b) == (canonical(a) == canonical(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(text, max_size=8))
def test_batch_hash_equals_letter_by_letter(texts):
    got = copies.text_hashes(pa.array(["x", *texts], pa.string()).slice(1))
    assert [int(x) for x in got] == [copies.fold_hash(canonical(t)) for t in texts]


def test_hash_tells_order_and_length_apart():
    h = copies.text_hashes(pa.array(["ab", "ba", "a", "aa", "", None, "A-b"]))
    assert len(set(h[:5].tolist())) == 5 and h[4] == h[5] and h[0] == h[6]


ONE = "Id_Eventos_Telemetria=1;Data_Evento=2025-01-01 02:00:00.000;TAG=PE4105;Id_Alarme=9;Valor=-1.5;Classe=Activate;Operador=OP_001"
SAME = [
    '{"operador": "op 001", "TAG": "pe-4105", "Valor": "-1.5", "Classe": "ACTIVATE", "IdAlarme": "9", "Data Evento": "2025/01/01  02:00:00,000", "id_eventos_telemetria": "1"}',
    "<TAG = '(PE4105)'> <Id Alarme = '9'> <Valor = ' -1.5'> <Classe = 'Activate'> <Operador = 'OP_001'> <Data Evento = '2025-01-01 02:00:00.000'> <Id Eventos Telemetria = '1'>",
    "  tag : PE–4105;\n  valor : -1.5;\n  classe : Activate;\n  operador : OP_001;\n  id_alarme : 9;\n  data_evento : 2025-01-01 02:00:00.000;\n  id_eventos_telemetria : 1.",
]
OTHER = [ONE.replace("-1.5", "1.5"), ONE.replace("-1.5", "-1.6"), ONE.replace("PE4105", "PE4106"), ONE.replace("Activate", ""), ONE.replace("=9;", "=90;"), ONE[:-3], ONE.replace("-1.5", "")]
BROKEN = [ONE[:60], "", None, "valor", ONE + ";TAG=PE4105", "x" * 100_000]


def test_records_in_other_notation():
    h, whole = FIELDS.hashes(pa.array([ONE, *SAME, *OTHER, *BROKEN]))
    assert whole.tolist() == [True] * 11 + [False] * 6
    assert len(set(h[:4].tolist())) == 1 and len(set(h[3:11].tolist())) == 8
    assert all(FIELDS.same(ONE, s) for s in SAME) and not any(FIELDS.same(ONE, s) for s in OTHER)


def test_groups_under_their_smallest_id(spark):
    rows = [(i, r) for i, r in enumerate([*SAME, ONE, *OTHER, *BROKEN, ONE, ONE])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, r, "h", 5) for i, r in rows] + [(None, ONE, "x", 1)], "raw_id long, registro string, h string, lead int").repartition(3)
    prints = copies.record_prints(df, "raw_id", "registro", FIELDS)
    got = sorted((r.lead, r.id) for r in copies.copies(prints, FIELDS.same).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (0, 17), (0, 18)]


def test_collisions_form_their_own_groups(spark):
    """All rows get one hash: the comparison alone must tell the groups apart."""
    words = ["a", "A.", "b", "B", "c", "b!", "a "]
    df = spark.createDataFrame(list(enumerate(words)), "id long, text string").select("id", F.lit(7).cast("long").alias("h"), "text")
    got = sorted((r.lead, r.id) for r in copies.copies(df, copies.same_folded).collect())
    assert got == [(0, 1), (0, 6), (2, 3), (2, 5)]


def test_hot_group_is_salted_and_whole(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 < 2, F.concat(F.lit("Hot "), F.when(F.col("id") % 2 == 0, "X").otherwise("x."))).otherwise(F.concat(F.lit("u"), F.col("id"))).alias("text"))
    prints = copies.keyed_prints(df, F.col("id"), [F.lit(1)], F.col("text"))
    out = copies.copies(prints, copies.same_folded, hot_share=0.01, salts=4)
    n = sum(i % 3 < 2 for i in range(5000))
    assert out.count() == n - 1 and [r.lead for r in out.select("lead").distinct().collect()] == [0]


def test_keys_count_and_nulls_are_no_copies(spark):
    t = datetime(2025, 1, 1)
    rows = [(1, t, 5, "PE1"), (2, t, 5, "pe-1"), (3, t, 6, "PE1"), (4, None, 5, "PE1"), (5, t, None, "PE1"), (6, t, 5, None), (7, t.replace(microsecond=1), 5, "PE1")]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, a long, tag string")
    prints = copies.keyed_prints(df, F.col("id"), [micros("ts"), F.col("a")], F.col("tag"))
    assert [(r.lead, r.id) for r in copies.copies(prints, copies.same_folded).collect()] == [(1, 2)]
    assert copies.copies(prints.where("false"), copies.same_folded).count() == 0


def test_powers_survive_long_buffers():
    texts = ["ab" * 5000, "x", "ab" * 5000 + "."]
    h = copies.text_hashes(pa.array(texts))
    assert h[0] == h[2] and h.dtype == np.uint64 and int(h[0]) == copies.fold_hash(texts[0])


def test_long_texts_over_many_stretches():
    rng = random.Random(3)
    make = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    texts = ["ab", make(200_001, "aB1 .-"), "", make(150_000, "aé –ß"), "x" * copies.STRETCH, "y" * (copies.STRETCH + 1), None, make(70_000, "日é,a"), "-" * 140_000]
    got = copies.text_hashes(pa.array(texts))
    assert [int(x) for x in got] == [copies.fold_hash(t or "") for t in texts]
    record = ONE.replace("OP_001", make(100_000, "ab -")), ONE.replace("OP_001", make(100_000, "aé –"))
    h, whole = FIELDS.hashes(pa.array([ONE, *record, *SAME, record[0].upper().replace("-", " - "), record[1].replace("–", " –")]))
    assert whole.all() and h[0] == h[3] == h[4] == h[5] and len({int(x) for x in h[:3]}) == 3
    assert h[2] == h[7] and h[1] != h[6] or "VALOR" in record[0].upper()


def test_a_large_batch_needs_bounded_memory():
    import resource

    copies.text_hashes(pa.array(["warm"]))
    texts = pa.array(["Abc-1 " * 1000] * 4000 + ["é–Abc " * 1000] * 4000)  # 24 + 32 million bytes
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    copies.text_hashes(texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB


def test_only_repeating_hashes_go_on(spark):
    rest = spark.range(20_000).select("id", F.xxhash64(F.col("id") % 19_000).alias("h"), F.lit("t").alias("text"))
    groups = rest.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1")
    rows = copies._repeating(rest, groups, 1000)
    ids = {r.id for r in rows.collect()}
    assert {i for i in range(20_000) if i < 1000 or i >= 19_000} <= ids and len(ids) < 4_500
