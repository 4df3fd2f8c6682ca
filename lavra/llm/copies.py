"""Copies hidden by formatting: records equal but for white space, letter case, punctuation or field order.

A record's bytes are streamed through a lookup table that skips what doesn't count and folds letter case, straight into
polynomial hashes; no canonical string is made. Rows of equal hash are compared with their group's smallest id by two
pointers that skip and fold as they go; rows that turn out different form groups of their own until none is left, so a
collision costs a round but never an error.

The hash of a segment is ``sum(fold[c_i] * B**i)`` over its kept characters, modulo two primes. A batch is hashed in
stretches of ``STRETCH`` characters: a running sum with exponents that start anew in each, a segment's share divided by
the power at its start, and segments that cross a border put together from their shares. So the tables of powers never
grow. ASCII text is taken as its bytes, other text as its code points through a table of the same kind; both give
an ASCII letter the same value.

Records are shuffled by what has a fixed width only. Hashes that occur once, nearly all, are never joined: those that
repeat set bits in a table of at most ``WORDS`` words, and rows whose bit isn't set go no further than their scan.

Nulls: a record with a null key part or without all its fields is no copy of anything (but keeps its row in counts).
Empty values equal empty values. Repeated rows are copies if their ids differ. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.session import staged, unstage

#: Two primes below 2**31 and a base for each; products of two residues fit into 64 bits.
PRIMES = (2_147_483_629, 2_147_483_587)
BASES = (911_382_323, 972_663_749)


def _fold_table() -> np.ndarray:
    table = np.zeros(256, np.uint64)
    for b in range(128):
        if chr(b).isalnum():
            table[b] = ord(chr(b).lower())
    return table


FOLD = _fold_table()


@lru_cache(maxsize=4096)
def fold_char(ch: str) -> str:
    """A letter or digit in its folded case, or nothing."""
    if not ch.isalnum():
        return ""
    low = ch.lower()
    return low if len(low) == 1 else ch


STRETCH = 1 << 16


def _powers(base: int, p: int) -> np.ndarray:
    """base**0 to base**STRETCH modulo p, by doubling."""
    t = np.ones(1, np.uint64)
    while len(t) <= STRETCH:
        t = np.concatenate([t, t * np.uint64(pow(base, len(t), p)) % np.uint64(p)])
    return t[: STRETCH + 1]


_UP = [_powers(b, p) for b, p in zip(BASES, PRIMES)]
_DOWN = [_powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES)]


class _CodeFold:
    """The folded code point of every code point (0: skipped), filled in as they are met."""

    UNKNOWN = np.uint32(0xFFFFFFFF)

    def __init__(self) -> None:
        self.table: np.ndarray | None = None

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.full(0x110000, self.UNKNOWN, np.uint32)
        out = self.table[codes]
        new = out == self.UNKNOWN
        if new.any():
            for c in np.unique(codes[new]).tolist():
                self.table[c] = ord(fold_char(chr(c)) or "\0")
            out = self.table[codes]
        return out.astype(np.uint64)


_fold_codes = _CodeFold()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of every segment [start, end) of ``data``: bytes of ASCII text, or code points (32 bits)."""
    n = len(starts)
    sums, seen = np.zeros((len(PRIMES), n), np.uint64), np.zeros(n, np.int64)
    order = np.argsort(starts, kind="stable")
    first, open_ones = 0, np.zeros(0, np.int64)  # segments begun in an earlier stretch that go on
    for low in range(0, len(data), STRETCH):
        high = min(low + STRETCH, len(data))
        last = first + int(np.searchsorted(starts[order[first:]], high))
        here = np.concatenate([open_ones, order[first:last]])
        first, open_ones = last, here[ends[here] > high]
        if not len(here):
            continue
        kept = FOLD[data[low:high]] if data.dtype == np.uint8 else _fold_codes(data[low:high])
        count = np.concatenate([[0], np.cumsum(kept > 0)])
        a, b = np.maximum(starts[here], low) - low, np.maximum(np.minimum(ends[here], high), starts[here].clip(low)) - low
        going_on = np.flatnonzero(seen[here])
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kept * _UP[k][count[1:]] % p, dtype=np.uint64)])
            share = (run[b] - run[a]) % p * _DOWN[k][count[a]] % p
            for i in going_on:
                share[i] = share[i] * np.uint64(pow(BASES[k], int(seen[here[i]]), int(p))) % p
            sums[k, here] = (sums[k, here] + share) % p
        seen[here] += count[b] - count[a]
    return sums[0] << np.uint64(31) | sums[1]


def fold_hash(text: str) -> int:
    """The same hash of one text, letter by letter."""
    sums, ups = [0, 0], [1, 1]
    for ch in text:
        if low := fold_char(ch):
            for k, p in enumerate(PRIMES):
                ups[k] = ups[k] * BASES[k] % p
                sums[k] = (sums[k] + ord(low) * ups[k]) % p
    return sums[0] << 31 | sums[1]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts one after the other, and where each starts."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), at


def _in_chunks(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Consecutive pieces of ``rows`` of about a million characters, or one longer text."""
    piece = np.cumsum(sizes) // 1_000_000
    yield from np.split(rows, np.flatnonzero(np.diff(piece)) + 1)


def same_folded(a: str, b: str, i: int = 0, i_end: int | None = None, j: int = 0, j_end: int | None = None) -> bool:
    """Whether two stretches are equal in what counts: two pointers, each skipping what doesn't."""
    i_end = len(a) if i_end is None else i_end
    j_end = len(b) if j_end is None else j_end
    while True:
        x = y = ""
        while i < i_end and not x:
            x = fold_char(a[i])
            i += 1
        while j < j_end and not y:
            y = fold_char(b[j])
            j += 1
        if x != y:
            return False
        if not x:
            return True


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, off - (off[0] if len(off) else 0)


def _beyond_ascii(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows hold bytes beyond ASCII."""
    out = np.zeros(len(off) - 1, bool)
    filled = np.flatnonzero(off[1:] > off[:-1])
    if len(filled):
        out[filled] = np.maximum.reduceat(raw, off[filled]) > 127
    return out


def text_hashes(texts: pa.Array) -> np.ndarray:
    """The folded hash of every text; a null counts as empty."""
    raw, off = _buffer(texts)
    out = fold_hashes(raw, off[:-1], off[1:])
    high = np.flatnonzero(_beyond_ascii(raw, off))
    for rows in _in_chunks(high, off[high + 1] - off[high]) if len(high) else ():
        codes, at = _codes(texts.take(pa.array(rows)).to_pylist())
        out[rows] = fold_hashes(codes, at[:-1], at[1:])
    return out


class Fields:
    """The named fields of a record in any order and notation: ``name = value``, ``"name": "value"`` and the like.

    ``signed`` names fields in which a minus sign before the digits counts.
    """

    MINUS = "-−"

    def __init__(self, names: Sequence[str], signed: Sequence[str] = ()) -> None:
        self.names, self.signed = tuple(names), tuple(self_n in signed for self_n in names)
        one = [r"[\W_]*".join(map(re.escape, n.split("_"))) for n in names]
        self.label = re.compile(r"(?<![^\W_])(?:" + "|".join(f"({x})" for x in one) + r")[\s\"']*[:=]", re.IGNORECASE)

    def spans(self, record: str) -> list[tuple[int, int]] | None:
        """Start and end of each field's value in the order of the names; None unless each field occurs exactly once."""
        found: list = [None] * len(self.names)
        last = -1
        for m in self.label.finditer(record):
            if found[m.lastindex - 1] is not None:
                return None
            if last >= 0:
                found[last] = (found[last], m.start())
            last = m.lastindex - 1
            found[last] = m.end()
        if last < 0 or any(x is None for x in found):
            return None
        found[last] = (found[last], len(record))
        return found

    def negative(self, record: str, start: int, end: int) -> bool:
        """Whether a minus sign stands before the first digit of the value."""
        for k in range(start, end):
            if record[k].isalnum():
                return record[start:k].rstrip()[-1:] in self.MINUS if record[start:k].rstrip() else False
        return False

    def same(self, a: str, b: str) -> bool:
        """Whether two records agree in every field."""
        if a == b:
            return True
        x, y = self.spans(a), self.spans(b)
        if x is None or y is None:
            return False
        return all(same_folded(a, b, *p, *q) and (not s or self.negative(a, *p) == self.negative(b, *q)) for p, q, s in zip(x, y, self.signed))

    def hashes(self, records: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every record and whether it has all fields."""
        raw, off = _buffer(records)
        high = _beyond_ascii(raw, off)
        n, w = len(records), len(self.names)
        starts, ends = np.zeros((n, w), np.int64), np.zeros((n, w), np.int64)
        whole, minus, beyond = np.zeros(n, bool), np.zeros((n, w), np.uint64), []
        for i, record in enumerate(records.to_pylist()):
            spans = self.spans(record) if record is not None else None
            if spans is None:
                continue
            whole[i] = True
            for f, signed in enumerate(self.signed):
                if signed:
                    minus[i, f] = self.negative(record, *spans[f])
            base = 0 if high[i] else off[i]
            if high[i]:
                beyond.append((i, record))
            for f, (s, e) in enumerate(spans):
                starts[i, f], ends[i, f] = base + s, base + e
        slow = np.array([i for i, _ in beyond], np.int64)
        plain = np.ones(n, bool)
        plain[slow] = False
        each = np.zeros((n, w), np.uint64)
        each[plain] = fold_hashes(raw, starts[plain].ravel(), ends[plain].ravel()).reshape(-1, w)
        for part in _in_chunks(np.arange(len(slow)), off[slow + 1] - off[slow]) if len(slow) else ():
            codes, at = _codes([beyond[i][1] for i in part])
            each[slow[part]] = fold_hashes(codes, (starts[slow[part]] + at[:-1, None]).ravel(), (ends[slow[part]] + at[:-1, None]).ravel()).reshape(-1, w)
        salts = _mix(np.arange(1, w + 1, dtype=np.uint64))
        return _mix(each * np.uint64(2) + minus + salts).sum(axis=1, dtype=np.uint64), whole


def record_prints(df: DataFrame, id_col: str, text_col: str, fields: Fields) -> DataFrame:
    """(id, h, text) of the records that have all fields."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, whole = fields.hashes(b.column(1))
            b = pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), b.column(1)], ["id", "h", "text"])
            yield b.filter(pa.array(whole))

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").mapInArrow(prints, "id long, h long, text string")


def keyed_prints(df: DataFrame, id_col: Column, keys: Sequence[Column], text: Column) -> DataFrame:
    """(id, h, k, text): hash of whole-number keys and a folded text; ``k`` holds the keys. Rows with a null part are left out."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = text_hashes(b.column(b.num_columns - 1))
            for c in range(1, b.num_columns - 1):
                h = _mix(h ^ (_mix(b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), *b.columns[1:]], ["id", "h", *names])

    names = [*(f"k{i}" for i in range(len(keys))), "text"]
    rows = df.select(id_col.cast("long").alias("id"), *[k.cast("long").alias(f"k{i}") for i, k in enumerate(keys)], text.alias("text")).na.drop()
    return rows.mapInArrow(prints, "id long, h long, " + ", ".join(f"k{i} long" for i in range(len(keys))) + ", text string")


def _verified(pairs: DataFrame, keys: int, same: Callable[[str, str], bool]) -> DataFrame:
    """``pairs`` of (lead, id, h, payload of both) with ``ok``: whether they agree in every part."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for k in range(keys):
                ok &= b.column(f"k{k}").to_numpy() == b.column(f"lead_k{k}").to_numpy()
            x, y = b.column("text").to_pylist(), b.column("lead_text").to_pylist()
            for i in np.flatnonzero(ok):
                ok[i] = x[i] == y[i] or same(x[i], y[i])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(ok)], [*columns, "ok"])

    columns = ["lead", "id", "h", *(f"k{k}" for k in range(keys)), "text"]
    schema = "lead long, id long, h long, " + "".join(f"k{k} long, " for k in range(keys)) + "text string, ok boolean"
    return pairs.mapInArrow(verify, schema)


WORDS = 1 << 19


def _repeating(rest: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """The rows of ``rest`` whose hash may be among ``groups`` (``n`` of them): all that are, and few others.

    What is broadcast has at most ``WORDS`` rows of 64 bits, however many groups there are.
    """
    words = 1 << min(WORDS.bit_length() - 1, max(6, (n * 16 // 64).bit_length()))
    word, bit = F.pmod(F.shiftright("h", 6), F.lit(words)).alias("word"), F.col("h").bitwiseAND(63).cast("int")
    table = groups.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    hit = F.getbit("bits", bit) == 1
    return rest.withColumn("word", word).join(F.broadcast(table), "word").where(hit).select(*rest.columns)


def copies(prints: DataFrame, same: Callable[[str, str], bool], hot_share: float = 0.001, salts: int = 32) -> DataFrame:
    """(lead, id): every row that is a copy, with the smallest id of its group.

    ``prints`` has id, h, optional whole-number keys k0, k1, ... and text. Hashes are counted by themselves, with their
    smallest id; only rows of a hash that repeats are shuffled with their text. Hashes that hold at least ``hot_share`` of
    the rows (at most 1 / hot_share of them) are joined to their rows in ``salts`` pieces, so the largest group doesn't
    end in one task.
    """
    keys = [c for c in prints.columns if c not in ("id", "h", "text")]
    payload = [*keys, "text"]
    rest = first = staged(prints, "prints")
    out, used = None, [first]
    while True:
        groups = staged(rest.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1"), "print-groups")
        used.append(groups)
        rows = _repeating(rest, groups, groups.count())
        least = max(1000, int(rest.count() * hot_share))
        leads = rows.join(groups.withColumnRenamed("lead", "id"), ["h", "id"]).dropDuplicates(["h", "id"])
        leads = leads.select("h", "n", F.col("id").alias("lead"), *[F.col(c).alias(f"lead_{c}") for c in payload])
        hot = groups.where(F.col("n") >= least).select("h", F.lit(salts).alias("salts"))
        spread = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))).drop("salts")
        leads = leads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") >= least, F.lit(salts - 1)).otherwise(0).cast("long"))))
        pairs = spread.join(leads, ["h", "salt"]).where("id <> lead")
        checked = staged(_verified(pairs, len(keys), same), "print-pairs")
        found = checked.where("ok").select("lead", "id")
        out = found if out is None else out.unionByName(found)
        rest = checked.where("NOT ok").select("id", "h", *payload)
        if rest.isEmpty():
            unstage(*used)
            return out
