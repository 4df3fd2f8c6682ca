"""Encoding against the public library, piece by piece and as a whole."""

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lavra.llm import tokens

TEXTS = ["", "a", "Hello  world\n\n\tx ", "A pressão caiu 33,7 bar!", "冷却水レベル低下", "<|endoftext|> plain", "👩‍🔧 ok\r\n", "a" * 3000, "鉱" * 700, "x1" * 900, "   ", "we'll I'm don't"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return tokens.encoder(*tokens.default_vocabulary())


def test_equals_the_library(library, own):
    for t in TEXTS:
        assert own.encode(t) == library(t)
        assert b"".join({v: k for k, v in own.ranks.items()}[i] for i in own.encode(t)).decode() == t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(library, own, text):
    assert own.encode(text) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=24))
def test_merges_as_a_scan_for_the_leftmost_minimum(own, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        ranks = [own.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        if min(ranks) == 1 << 40:
            break
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert tokens.merged(piece, own.ranks) == [own.ranks[p] for p in parts]


def test_rows(spark, library):
    rows = [(i, t, "ids") for i, t in enumerate([*TEXTS, None, TEXTS[3]])]
    out = {r.id: r.ids for r in tokens.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text").collect()}
    assert out == {i: library(t or "") for i, t, _ in rows}
    assert tokens.encoded(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
