"""Mixing sources to target weights by soft membership.

Every document has a membership vector over the target sources. Where its written source is a target, that is certain.
Where it isn't (null, unknown), a classifier fitted on all labelled documents (multinomial naive Bayes over hashed words;
its table of counts has at most sources times ``BUCKETS`` cells) predicts the posterior. With tokens t, memberships P and
rates r, source k gets S_k = sum(t * r * P_k) tokens; the rates minimise sum((S_k - T_k)^2 / A_k) over 0 <= r <= cap by
projected gradient steps from one rate for all. A step needs the k sums only: certain documents of a source share their
rate, so they are one group each, however many there are; those of the others are summed on the cluster at every step,
from rates that are stored every ``STORED`` steps. The steps end when the sums meet their targets or the caps let them
come no closer; a fit that does neither raises an error. What is left of the distance is given with the mixture.

The unit is the distinct text: copies, under any id or source, share one cap. A text's source is that of its smallest
id among those with a target source. T_k is the target share of ``total``; left out, the total is the largest at which
every source that has tokens can reach its share within its cap, so nothing but missing sources can miss its target.

Rates become whole numbers of copies: floor(r) for each text, and one more for the texts at the head of a fixed random
order of each source, as many as have the tokens the fractions add up to. The head ends inside one bucket of the order;
only that bucket is ordered row by row.

Null and empty texts have no tokens and are never used. Target rows with null source or weight are left out, sources are
compared without outer blanks and letter case, repeated targets add up (with their smallest cap). With no targets or no
documents the mixture is empty and reached shares are null.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.text import strip_outer
from lavra.llm.tokens import counter
from lavra.session import staged, unstage

BUCKETS = 8192
ORDER_BUCKETS = 4096
HELD_WORDS = 200_000
STORED = 8
_WORD = re.compile(r"[^\W\d_]+|\d")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % BUCKETS


@dataclass
class Posterior:
    """A multinomial naive Bayes model: log priors and log word probabilities."""

    prior: np.ndarray
    word: np.ndarray

    def __call__(self, text: str) -> list[float]:
        """The posterior over the sources. Words of one text aren't independent: their evidence is damped by its root."""
        found: Counter = Counter(map(_bucket, _words(text)))
        score = self.prior.copy()
        if found:
            n = np.array(list(found.values()), float)
            score = score + (self.word[:, list(found)] @ n) / max(1.0, np.sqrt(n.sum()) / 2)
        p = np.exp(score - score.max())
        return [float(x) for x in p / p.sum()]


def fit_posterior(df: DataFrame, sources: int) -> Posterior:
    """Fit on (src, text): ``src`` is a number below ``sources``; all rows count, the sums are a small table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, docs = np.zeros((sources, BUCKETS), np.int64), np.zeros(sources, np.int64)
        held: list[Counter] = [Counter() for _ in range(sources)]

        def empty() -> None:  # words are counted as they are and hashed once
            for s, words in enumerate(held):
                np.add.at(table[s], [_bucket(w) for w in words], list(words.values()))
                words.clear()

        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs[s] += 1
                held[s].update(_words(t))
            if sum(map(len, held)) > HELD_WORDS:
                empty()
        empty()
        s, k = np.nonzero(table)
        src = np.concatenate([s, np.arange(sources)])
        bucket = np.concatenate([k, np.full(sources, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int32()), pa.array(bucket, pa.int32()), pa.array(np.concatenate([table[s, k], docs]))], ["src", "bucket", "n"])

    sums = df.select("src", "text").mapInArrow(count, "src int, bucket int, n long").groupBy("src", "bucket").agg(F.sum("n").alias("n")).collect()
    table, docs = np.zeros((sources, BUCKETS)), np.zeros(sources)
    for r in sums:
        if r["bucket"] < 0:
            docs[r["src"]] = r["n"]
        else:
            table[r["src"], r["bucket"]] = r["n"]
    with np.errstate(divide="ignore"):
        prior = np.where(docs > 0, np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), -1e9)
    smooth = table + 0.1
    return Posterior(prior, np.log(smooth / smooth.sum(axis=1, keepdims=True)))


def _source(c: Column) -> Column:
    return F.lower(strip_outer(c))


def targets_of(targets: DataFrame, source: str, weight: str, cap: str) -> list[tuple[str, float, int]]:
    """The wanted shares, one row per source, in order of their names."""
    rows = targets.groupBy(_source(F.col(source)).alias("s")).agg(F.sum(weight).alias("w"), F.min(cap).alias("c")).where("s IS NOT NULL AND w IS NOT NULL")
    return sorted((r["s"], float(r["w"]), int(r["c"] if r["c"] is not None else 1)) for r in rows.collect())


def units(df: DataFrame, wanted: list[tuple[str, float, int]], id_col: str, text_col: str, source_col: str, vocabulary: str | None = None) -> DataFrame:
    """One row per distinct text with tokens: (doc_id, src, tokens, post), ``src`` -1 and ``post`` the posterior if its source is no target."""
    names = [w[0] for w in wanted]
    index = F.coalesce(*[F.when(F.col("s") == n, i) for i, n in enumerate(names)], F.lit(-1))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _source(F.col(source_col)).alias("s"))
    rows = rows.where(F.length("text") > 0).select("doc_id", index.alias("src"), "text")
    posterior = fit_posterior(rows.where("src >= 0"), len(names))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = counter(vocabulary)
        for b in batches:
            texts, src = b.column(2).to_pylist(), b.column(1).to_pylist()
            key = [hashlib.md5(t.encode()).digest() for t in texts]
            post = [None if s >= 0 else posterior(t) for s, t in zip(src, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(key, pa.binary()), pa.array([size(t) for t in texts], pa.int64()), pa.array(post, pa.list_(pa.float64()))],
                ["doc_id", "src", "key", "tokens", "post"],
            )

    measured = rows.mapInArrow(measure, "doc_id long, src int, key binary, tokens long, post array<double>")
    first = F.min(F.struct((F.col("src") < 0).alias("loose"), "doc_id", "src", "tokens", "post")).alias("u")
    return measured.groupBy("key").agg(first).select("u.doc_id", "u.src", "u.tokens", "u.post")


class Steps(list):
    """Gradient steps (vectors over the sources), with the largest distance from a target left, in shares of all tokens."""

    residual: float = 0.0


def fit_rates(
    groups: list[tuple[np.ndarray, float, float]], goal: np.ndarray, available: np.ndarray, start: np.ndarray, others: Callable[[list[np.ndarray]], np.ndarray] | None = None,
    steps: int = 200, tolerance: float = 1e-5,
) -> Steps:
    """The gradient steps, until the sums stay put.

    ``groups`` are documents of one membership and cap, with their tokens; ``others`` gives the sums of all other
    documents after some steps, an aggregation on the cluster. The driver holds nothing but sums. A document's rate
    after the steps is :func:`rates` of its membership and cap.
    """
    member = np.array([g[0] for g in groups]).reshape(len(groups), len(goal))
    cap, tokens = np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
    r = np.clip(member @ start, 0, cap)
    out, all_tokens, before = Steps(), max(goal.sum(), 1), np.inf
    scale = np.where(available > 0, available, 1.0)
    for k in range(steps + 1):
        off = member.T @ (tokens * r) + (0 if others is None else others(out)) - goal
        out.residual = float(np.abs(off).max(initial=0) / all_tokens)
        distance = float((off**2 / scale).sum())
        if out.residual <= tolerance or distance >= before * (1 - 1e-6):
            return out
        if k == steps:
            raise RuntimeError(f"the rates don't settle within {steps} steps; {out.residual:.6f} of all tokens is missing")
        before = distance
        out.append(off / scale)
        r = np.clip(r - member @ out[-1], 0, cap)
    return out


def rates(member: Column, cap: Column, start: np.ndarray, steps: list[np.ndarray], stored: Column | None = None) -> Column:
    """The rate of a document: the same steps from the same start (or a stored rate), projected onto [0, cap] each time."""

    def dot(v: np.ndarray) -> Column:
        return F.aggregate(F.zip_with(member, F.lit([float(x) for x in v]), lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)

    zero = F.lit(0.0)
    first = F.greatest(zero, F.least(cap, dot(start))) if stored is None else stored
    return reduce(lambda r, g: F.greatest(zero, F.least(cap, r - dot(g))), steps, first)


class _Loose:
    """The texts whose source is no target, with the rates of some steps stored."""

    def __init__(self, table: DataFrame, k: int, cap: float, start: np.ndarray) -> None:
        self.table, self.k, self.cap, self.start, self.done = staged(table, "mix-loose"), k, F.lit(float(cap)), start, 0

    def sums(self, of: Column) -> np.ndarray:
        row = self.table.agg(*[F.sum(F.col("tokens") * of * F.get("post", F.lit(i))) for i in range(self.k)]).first()
        return np.array([x or 0.0 for x in row])

    def after(self, steps: list[np.ndarray]) -> np.ndarray:
        rate = rates(F.col("post"), self.cap, self.start, steps[self.done :], F.col("rate") if self.done else None)
        if len(steps) - self.done >= STORED:
            last, self.table = self.table, staged(self.table.select("tokens", "post", rate.alias("rate")), "mix-loose")
            self.done, rate = len(steps), F.col("rate")
            unstage(last)
        return self.sums(rate)


def held_out_accuracy(df: DataFrame, sources: int, folds: int = 3) -> tuple[float, float]:
    """How often the largest posterior of a labelled text (src, text) is its own source, from classifiers that were fitted
    without it or its copies, and how often the most frequent source is."""
    rows = df.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(folds)).cast("int"))
    hit = n = 0
    for k in range(folds):
        posterior = fit_posterior(rows.where(F.col("fold") != k).select("src", "text"), sources)

        def hits(batches: Iterator[pa.RecordBatch], posterior=posterior) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([int(np.argmax(posterior(t))) == s for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_())], ["hit"])

        row = rows.where(F.col("fold") == k).select("src", "text").mapInArrow(hits, "hit boolean").agg(F.count_if("hit"), F.count("*")).first()
        hit, n = hit + row[0], n + row[1]
    most = df.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    return (hit / n, most / n) if n else (0.0, 0.0)


@dataclass
class Mixture:
    """The used texts (doc_id, source, tokens, rate, copies), the shares reached, how many steps were taken and how far the
    fitted sums stay from their targets, in shares of all tokens."""

    used: DataFrame
    shares: DataFrame
    steps: int = 0
    residual: float = 0.0


def mix(
    spark: SparkSession, docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    target_cols: tuple[str, str, str] = ("source", "peso_alvo", "max_repeticoes"), total: float | None = None, loose_cap: float = 1.0, vocabulary: str | None = None,
) -> Mixture:
    """Fit and round a mixture. ``loose_cap`` bounds the uses of a text whose source is no target; 0 leaves such texts out."""
    wanted = targets_of(targets, *target_cols)
    names, k = [w[0] for w in wanted], len(wanted)
    weight, caps = np.array([w[1] for w in wanted]), np.array([float(w[2]) for w in wanted])
    used_type = "doc_id long, source string, tokens long, rate double, copies int"
    share_type = "source string, peso_alvo double, max_repeticoes int, tokens_unicos long, tokens long, share double, tokens_esperados double, share_esperado double, repeticoes int"
    if not k:
        return Mixture(spark.createDataFrame([], used_type), spark.createDataFrame([], share_type))
    table = staged(units(docs, wanted, id_col, text_col, source_col, vocabulary).where("tokens > 0"), "mix-units")
    unit_vectors = F.array(*[F.lit([float(i == j) for j in range(k)]) for i in range(k)])
    member = F.when(F.col("src") >= 0, F.get(unit_vectors, F.col("src"))).otherwise(F.col("post"))
    cap = F.when(F.col("src") >= 0, F.get(F.lit([float(c) for c in caps]), F.col("src"))).otherwise(F.lit(float(loose_cap)))

    certain = {r["src"]: (float(r["t"]), int(r["n"])) for r in table.where("src >= 0").groupBy("src").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    groups = [(np.eye(k)[i], caps[i], t) for i, (t, _) in certain.items()]
    loose = _Loose(table.where(F.col("src") < 0 if loose_cap > 0 else F.lit(False)).select("tokens", "post"), k, loose_cap, np.zeros(k))
    available = sum((g[0] * g[2] for g in groups), np.zeros(k)) + loose.sums(F.lit(1.0))
    sure = np.array([certain.get(i, (0.0, 0))[0] for i in range(k)])
    reachable = sure > 0
    if total is None:
        total = float(np.min((sure * caps)[reachable & (weight > 0)] / weight[reachable & (weight > 0)])) if (reachable & (weight > 0)).any() else 0.0
    goal = np.where(reachable, weight * total, 0.0)
    start = loose.start = np.full(k, min(float(caps.max()), goal.sum() / max(available.sum(), 1.0)))  # one rate for all
    steps = fit_rates(groups, goal, available, start, loose.after)

    rated = table.withColumn("rate", rates(member, cap, start, steps)).withColumn("member", member)
    rated = rated.withColumn("dom", F.array_position("member", F.array_max("member")).cast("int") - 1)
    rated = rated.withColumn("frac", F.col("rate") - F.floor("rate")).withColumn("order", F.xxhash64("doc_id", F.lit(17)))
    rated = rated.withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 40), F.lit(ORDER_BUCKETS)).cast("int"))
    rated = staged(rated.select("doc_id", "src", "tokens", "rate", "member", "dom", "frac", "order", "bucket", (F.col("src") >= 0).alias("sure")), "mix-rates")
    heads = rated.groupBy("dom", "sure", "bucket").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("frac")).alias("f"))
    w = Window.partitionBy("dom", "sure").orderBy("bucket")
    heads = heads.select("dom", "sure", "bucket", (F.sum("t").over(w) - F.col("t")).alias("before"), "t", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("budget"))
    placed = rated.join(heads, ["dom", "sure", "bucket"])
    whole = F.col("before") + F.col("t") <= F.col("budget")
    edge = placed.where(~whole & (F.col("before") < F.col("budget")))
    inside = Window.partitionBy("dom", "sure", "bucket").orderBy("order", "doc_id")
    edge = edge.withColumn("extra", (F.col("before") + F.sum("tokens").over(inside) - F.col("tokens") / 2 <= F.col("budget")).cast("int"))
    others = placed.where(whole | (F.col("before") >= F.col("budget"))).withColumn("extra", whole.cast("int"))
    copies = F.floor("rate").cast("int") + F.when(F.col("frac") > 0, F.col("extra")).otherwise(0)
    counted = staged(edge.unionByName(others).withColumn("copies", copies).where("copies > 0"), "mix-copies")
    used = counted.select("doc_id", F.when(F.col("sure"), F.get(F.lit(names), F.col("dom"))).alias("source"), "tokens", "rate", "copies")

    out_tokens = F.col("tokens") * F.col("copies")
    hard = {r["src"]: (int(r["t"]), int(r["m"])) for r in counted.groupBy("src").agg(F.sum(out_tokens).alias("t"), F.max("copies").alias("m")).collect()}
    soft_sums = counted.agg(*[F.sum(out_tokens * F.get("member", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
    soft = [float(soft_sums[i] or 0.0) for i in range(k)]
    every = sum(t for t, _ in hard.values())
    rows = []
    for i, (name, wanted_share, wanted_cap) in enumerate(wanted):
        t, m = hard.get(i, (0, 0))
        rows.append((name, wanted_share, wanted_cap, int(sure[i]), t, t / every if every else None, soft[i], soft[i] / every if every else None, m))
    if -1 in hard:
        t, m = hard[-1]
        rows.append((None, 0.0, int(np.ceil(loose_cap)), 0, t, t / every, 0.0, 0.0, m))
    unstage(table, loose.table, rated)
    return Mixture(used, spark.createDataFrame(rows, share_type), len(steps), steps.residual)
