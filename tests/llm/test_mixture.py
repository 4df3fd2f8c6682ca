"""The mixture's shares, caps and units."""

import random

import numpy as np
import pytest

from lavra.llm import mixture, tokens

TARGETS = [("A ", 0.5, 2), ("b", 0.3, 3), ("c", 0.15, 4), ("nowhere", 0.05, 1), (None, 0.2, 1)]
DOC = "doc_id long, text string, source string, src string, tokens int, copies int"
WORDS = {"a": "bomba pressão óleo", "b": "email prezado senhor", "c": "manual capítulo figura"}


def docs(n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        s = rng.choice("aaaaab") if i % 20 else "c"
        words = WORDS[s].split()
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) + f" {i}"
        rows.append((i, t, rng.choice([s, s.upper(), f" {s} "]) if rng.random() > 0.05 else rng.choice([None, "other"])))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(30)]  # copies
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, "  \n", "b"), (2003, "x " * 200, "a")]
    return [(*r, "z", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = docs()
    targets = spark.createDataFrame(TARGETS, "source string, peso_alvo double, max_repeticoes int")
    m = mixture.mix(spark, spark.createDataFrame(rows, DOC).repartition(3), targets)
    assert m.steps > 0 and m.residual <= 1e-5
    return rows, m.used.collect(), {r.source: r for r in m.shares.collect()}


def test_shares_meet_the_targets(mixed):
    _, used, shares = mixed
    reach = 1 / 0.95  # 'nowhere' has no texts
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(shares[s].share_esperado - w * reach) < 0.03
    assert shares["nowhere"].tokens == 0
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-9


def test_caps_and_units(mixed):
    rows, used, _ = mixed
    text = {r[0]: r[1] for r in rows}
    assert len({text[r.doc_id] for r in used}) == len(used)  # copies are one unit
    assert all(r.doc_id < 1000 or r.doc_id in (2002, 2003) for r in used)
    cap = {"a": 2, "b": 3, "c": 4, None: 1}
    count = tokens.counter()
    for r in used:
        assert 1 <= r.copies <= cap[r.source] and r.tokens == count(text[r.doc_id])
        assert r.copies in (int(np.floor(r.rate)), int(np.floor(r.rate)) + 1)
    assert any(r.copies == cap["c"] for r in used if r.source == "c")


def test_rates_equal_projected_least_squares():
    rng = np.random.default_rng(1)
    member = rng.dirichlet(np.ones(3), 40)
    cap, tok = rng.uniform(0.5, 3, 40), rng.uniform(1, 50, 40)
    goal = member.T @ (tok * np.clip(rng.uniform(0, 1, 40), 0, cap))
    available = member.T @ tok
    start = goal / available
    steps = mixture.fit_rates(list(zip(member, cap, tok)), goal, available, start, steps=500)
    r = np.clip(member @ start, 0, cap)
    for g in steps:
        r = np.clip(r - member @ g, 0, cap)
    assert np.abs(member.T @ (tok * r) - goal).max() <= 1e-3 * goal.sum() and (r >= 0).all() and (r <= cap + 1e-12).all()


def test_uniform_start_stored_rates_and_what_is_out_of_reach(spark, monkeypatch):
    rng = np.random.default_rng(2)
    member = rng.dirichlet(np.ones(3) * 0.5, 60)
    tok, available = rng.uniform(1, 50, 60), None
    available = member.T @ tok
    goal = np.array([0.5, 0.3, 0.2]) * tok.sum() * 0.4
    start = np.full(3, 0.4)
    df = spark.createDataFrame([(float(t), [float(x) for x in m]) for t, m in zip(tok, member)], "tokens double, post array<double>")
    monkeypatch.setattr(mixture, "STORED", 2)
    loose = mixture._Loose(df, 3, 1.0, start)
    steps = mixture.fit_rates([], goal, available, start, loose.after)
    want = mixture.fit_rates(list(zip(member, np.ones(60), tok)), goal, available, start)
    assert len(steps) == len(want) > 3 and loose.done >= 2 and np.allclose(steps, want) and steps.residual <= 1e-5
    with pytest.raises(RuntimeError, match="settle"):
        mixture.fit_rates(list(zip(member, np.ones(60), tok)), goal, available, start, steps=1)
    # beyond the caps the steps end at what can be reached, and the distance is told
    far = mixture.fit_rates([(np.array([1.0, 0]), 1.0, 10.0), (np.array([0, 1.0]), 1.0, 10.0)], np.array([20.0, 5.0]), np.array([10.0, 10.0]), np.full(2, 0.5))
    assert 0.39 < far.residual < 0.41


def test_held_out_accuracy(spark):
    rows = [(i % 3, f"{WORDS['abc'[i % 3]]} {i}") for i in range(120)] + [(0, "bomba pressão 0")] * 20
    hit, most = mixture.held_out_accuracy(spark.createDataFrame(rows, "src int, text string"), 3)
    assert hit > 0.95 and abs(most - 60 / 140) < 1e-9


def test_posterior_on_held_out_texts(spark):
    rows = [r for r in docs(600) if r[1] and r[2] and r[2].strip().lower() in "abc" and r[0] < 1000]
    index = {"a": 0, "b": 1, "c": 2}
    train = spark.createDataFrame([(index[r[2].strip().lower()], r[1]) for r in rows[::2]], "src int, text string")
    p = mixture.fit_posterior(train, 3)
    held = rows[1::2]
    assert sum(int(np.argmax(p(r[1]))) == index[r[2].strip().lower()] for r in held) / len(held) > 0.95
    assert abs(sum(p("")) - 1) < 1e-9


def test_very_long_text_is_used_whole_or_not(spark):
    rows = [(r[0], r[1] if r[0] else "x " * 20_000, r[2], "z", 1, 2) for r in docs(60)]
    targets = spark.createDataFrame(TARGETS, "source string, peso_alvo double, max_repeticoes int")
    used = mixture.mix(spark, spark.createDataFrame(rows, DOC), targets).used.collect()
    assert all(r.tokens == tokens.counter()("x " * 20_000) for r in used if r.doc_id == 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "source string, peso_alvo double, max_repeticoes int")
    some = spark.createDataFrame(TARGETS, none.schema)
    d = spark.createDataFrame(docs(40), DOC)
    assert mixture.mix(spark, d, none).used.count() == 0
    m = mixture.mix(spark, d.where("false"), some)
    assert m.used.count() == 0 and all(r.share is None for r in m.shares.collect())
    assert mixture.mix(spark, d, some, loose_cap=0).used.where("source IS NULL").count() == 0
