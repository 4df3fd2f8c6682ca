"""Look-alike text: every planted form is found and led back, ordinary and foreign names stay."""

import random
import unicodedata

import pytest

from lavra.llm import lookalike as L

NAMES = ["VIBRAÇÃO EXCESSIVA COMPRESSOR DE AR II", "Tilt Sensor L-R Pressure High", "∠ CAÇAMBA > 12°", "NÍVEL BAIXO GIRO 2", "Turbo Inlet (L-2140)", "ISOLAÇÃO < 5 MΩ", "σ VIBRAÇÃO EIXO", "ΔP FILTRO PILOTO", "COEF. λ FORA DA FAIXA"]
FOREIGN = ["ДАВЛЕНИЕ ЖИДКОСТИ", "защита двигателя", "ПЕРЕГРЕВ ЦИЛИНДРА (L-960)", "НАСОС ДАВЛЕНИЕ", "冷却水レベル低下", "油圧ポンプ異常", "ΠΙΕΣΗ ΛΑΔΙΟΥ", "НЕТ СВЯЗИ"]


@pytest.mark.parametrize("name", NAMES + FOREIGN)
def test_ordinary_names_are_no_finding(name):
    for form in (name, f" {name} ", name.replace(" ", "  "), f"{name}\t", name.lower(), name.title()):
        form = unicodedata.normalize("NFC", form)
        assert L.analysed(form) == (" ".join(form.split()), False)


def planted(name, rng):
    kind = rng.choice(["wide", "nfd", "hidden", "space", "cyr", "grk", "all"])
    if kind == "wide":
        return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and rng.random() < 0.4 else c for c in name)
    if kind == "nfd":
        return unicodedata.normalize("NFD", name)
    if kind == "hidden":
        k = rng.randrange(len(name))
        return name[:k] + rng.choice("​‌‍⁠﻿­") + name[k:]
    if kind == "space":
        return name.replace(" ", rng.choice("    　"))
    table = {v: k for k, v in (L.CYRILLIC if kind != "grk" else L.GREEK).items()}
    p = 1.0 if kind == "all" else 0.5
    return "".join(table[c] if c.isalpha() and c in table and rng.random() < p else c for c in name)


def test_planted_forms_are_found_and_led_back():
    rng = random.Random(7)
    for _ in range(2000):
        name = rng.choice(NAMES[:5])
        form = planted(name, rng)
        assert L.analysed(form) == (name, form != name), ascii(form)


def test_foreign_names_with_hidden_characters():
    assert L.analysed("ДАВЛЕНИЕ ЖИДКОСТИ") == ("ДАВЛЕНИЕ ЖИДКОСТИ", True)
    assert L.analysed("ﾎﾟﾝﾌﾟ") == ("ポンプ", True)
    assert L.analysed("ДABЛEHИE ЖИДКОСТИ")[0] == "ДАВЛЕНИЕ ЖИДКОСТИ"  # Latin letters within a Cyrillic word


def test_tokens_that_stay():
    assert L.token_scripts("ΔP") == frozenset() and L.token_scripts("AR") == frozenset({"Latn"})
    assert "Jpan" in L.token_scripts("冷却レベル")
    assert L.analysed("ΔP АR") == ("ΔP AR", True)
    assert L.analysed("кabine 10 кВт") == ("kabine 10 кВт", True)
    assert L.analysed("5 m², 1ª, ½, 20 ℃, µm") == ("5 m², 1ª, ½, 20 ℃, µm", False)


def test_nulls_empty_long_and_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "  ", "c"), (4, "Plаin", None), (4, "Plаin", None), (5, "​" * 20_000 + "x", "d")]
    out = L.normalized(spark.createDataFrame(rows, "id long, lv_form string, lv_text string"), "lv_form", "id").collect()
    got = sorted((r.id, r.lv_form, r.lv_odd) for r in out if r.id != 1)
    assert got == [(2, "", False), (3, "", False), (4, "Plain", True), (4, "Plain", True), (5, "x", True)]
    assert [(r.lv_form, r.lv_odd) for r in out if r.id == 1] == [(None, False)]
    assert L.normalized(spark.createDataFrame([], "id long, t string"), "t", "id").count() == 0


@pytest.mark.parametrize("text, form", [("ꓔemp", "Temp"), ("ᖴreio", "Freio"), ("τemp", "temp"), ("Ⲟil", "Oil"), ("ηivel", "nivel"), ("ᴛemp alta", "temp alta"), ("ᏴOMBA", "BOMBA")])
def test_letters_of_other_scripts(text, form):
    assert L.analysed(text) == (form, True)


def test_mixed_scripts_are_found_without_a_known_spelling():
    for text in ("temⴼ baixa", "𐊠BOMBA", "filtroЖ", "óleoδα τ"):
        assert L.analysed(text)[1] and text[:3] in L.consistent(text) or text.startswith("𐊠")
    for text in ("5 kΩ", "ΔT alto", "3 μm", "CPUエラー", "A駆動", "ปั๊มABC", "τ", "σ eixo", "x²"):
        assert L.analysed(text) == (text, False)
