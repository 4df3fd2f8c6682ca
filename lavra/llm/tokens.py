"""Encoding of a corpus with a public byte-level BPE tokenizer.

A text is cut by the tokenizer's pattern into pieces; within a piece the pair of lowest rank is merged, leftmost first,
until no pair has a rank. A segment tree over the piece's byte positions holds at its root the leftmost minimum of the
pair ranks (a leaf is ``rank * size + position``). A merge changes the leaves of three live neighbours at most, each by
one walk to the root, so a piece of n bytes takes O(n log n), be it a word or a text without any break.

Pieces up to ``CACHED_BYTES`` are remembered per process, in a table of bounded size.

Null and empty texts get an empty list. Strings of special tokens are ordinary text. Repeated rows are encoded each.
Extra columns are ignored. Nothing is shuffled: a long document is one row and stays whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_BYTES = 48
CACHED_PIECES = 400_000
_NONE = 1 << 62


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """The path of an installed public vocabulary and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # end of the live part that starts at a position
    prev = list(range(-1, n))  # start of the live part before it

    def put(leaf: int, value: int) -> None:
        i = size + leaf
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    while tree[1] != _NONE:
        i = tree[1] % size
        j = end[i]  # the right neighbour, absorbed now
        k = end[i] = end[j]
        if tree[size + j] != _NONE:
            put(j, _NONE)
        if k < n:
            prev[k] = i
            r = get(piece[i : end[k]])
            put(i, _NONE if r is None else r * size + i)
        else:
            put(i, _NONE)
        h = prev[i]
        if h >= 0:
            r = get(piece[h:k])
            put(h, _NONE if r is None else r * size + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """A byte-level BPE vocabulary read from a file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known, ranks = self.known, self.ranks
        for m in self.pieces.finditer(text):
            piece = m.group()
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode()
                ids = merged(raw, ranks)
                if len(raw) <= CACHED_BYTES:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """The process's encoder of a vocabulary; each worker reads the file once."""
    return Encoder(path, pattern)


def encoded(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every row's text."""
    own = default_vocabulary()
    path, pattern = path or own[0], pattern or own[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            rows = [np.array(e.encode(t), np.int32) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate([*rows, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, "id long, ids array<int>")


def counter(path: str | None = None, pattern: str | None = None) -> Callable[[str | None], int]:
    """The number of tokens of a text."""
    own = default_vocabulary()
    e = encoder(path or own[0], pattern or own[1])
    return lambda text: len(e.encode(text))
