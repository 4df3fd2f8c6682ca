"""One consistent form for texts that look the same but are written with different characters.

Each token's letters have resolved script sets (their Unicode script extensions, East Asian scripts widened to the
writing systems they belong to). The sets are intersected across the token:

* empty: the token mixes scripts. It gets the spelling of one script if every letter of the others looks like a letter
  of it: Latin first, else the script of its letters that look like no Latin one.
* one foreign script, every letter of which looks like a Latin one (whole-script confusable): it is Latin if the rest of
  the text is, and stays as it is if another token shows that the text really uses its script.
* otherwise the token is consistent and stays.

A token that mixes scripts is a finding in any case, even where no spelling is known (it then stays), with two exceptions:
scripts that are written without blanks beside Latin words (Chinese, Japanese, Korean, Thai, Arabic, Indic ones), and
Greek letters that look like no Latin one, which are signs (``kΩ``, ``ΔT``, ``μm``).

Before that, invisible characters go, blanks of any kind become U+0020, width and font variants and ligatures become
their plain letters, and accents are composed. Signs (degree, superscripts, fractions, a Greek letter standing alone)
stay. White space is then made single and outer blanks go.

Null gives null, empty and blank text give empty text. Each distinct text is worked out once per process (a bounded
cache), rows are taken by dictionary codes, so copies of one text cost nothing and cause no skew; nothing is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the basic Latin letters they look like.
CYRILLIC = dict(zip("АВЕЗІЈКМНОРСЅТУХЬҮԌԚԜ" "аеѕіјорсухһԁԛԝѵү", "ABE3IJKMHOPCSTYXbYGQW" "aesijopcyxhdqwvy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "αικνορυϲϳ" "τησ", "ABEZHIKMNOPTYX" "aikvopucj" "tno"))
ARMENIAN = dict(zip("ՍՏՕԼ" "հոսօցզ", "USOL" "hnuogq"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"))
COPTIC = dict(zip("ⲀⲂⲈⲌⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ" "ⲓⲕⲟⲣⲥⲩⲭ", "ABEZHIKMNOPCTYX" "ikopcyx"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
CANADIAN = dict(zip("ᗅᗷᑕᗞᖴᕼᒍᒪᗰᑭᖇᔕᑌᐯᗯ᙭", "ABCDFHJLMPRSUVWX"))
DESERET = dict(zip("𐐄𐐕𐐛𐐠𐐬𐐽𐑄", "OCLSocl"))
LATIN_ODD = dict(zip("ıɑɡɩ" "ᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "iagi" "abcdeghijklmnoprstuvwyz"))
# Small letters whose capitals look like Latin ones; within a token of Latin letters they stand for them.
SMALL_CAPITALS = dict(zip("вкмнт", "bkmht"))
# Punctuation that looks like basic Latin punctuation.
PUNCTUATION = dict(zip("‐‑−˗⁃∕⁄∶꞉", "-----//::"))

TO_LATIN = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC | LISU | CANADIAN | DESERET | LATIN_ODD
_OF_SCRIPT = {"Cyrl": CYRILLIC, "Grek": GREEK, "Armn": ARMENIAN, "Cher": CHEROKEE, "Copt": COPTIC, "Lisu": LISU, "Cans": CANADIAN, "Dsrt": DESERET}
#: For each script its letter that looks like a Latin one.
FROM_LATIN = {s: {v: k for k, v in reversed(t.items())} for s, t in _OF_SCRIPT.items()}

_LATIN, _GREEK = frozenset({"Latn"}), frozenset({"Grek"})
_SCRIPTS = {
    "Latn": "Latin", "Grek": "Greek", "Cyrl": "Cyrillic", "Armn": "Armenian", "Cher": "Cherokee", "Hani": "Han", "Hira": "Hiragana", "Kana": "Katakana", "Hang": "Hangul", "Bopo": "Bopomofo",
    "Arab": "Arabic", "Hebr": "Hebrew", "Deva": "Devanagari", "Thai": "Thai", "Copt": "Coptic", "Lisu": "Lisu", "Cans": "Canadian_Aboriginal", "Dsrt": "Deseret",
    "Beng": "Bengali", "Taml": "Tamil", "Telu": "Telugu", "Gujr": "Gujarati", "Guru": "Gurmukhi", "Knda": "Kannada", "Mlym": "Malayalam", "Laoo": "Lao", "Khmr": "Khmer", "Mymr": "Myanmar",
}
_IS_SCRIPT = {code: regex.compile(rf"\p{{Script_Extensions={name}}}") for code, name in _SCRIPTS.items()}
_ANY = regex.compile(r"[\p{Script_Extensions=Common}\p{Script_Extensions=Inherited}]")
#: Scripts whose words stand beside Latin ones without a blank.
_BESIDE_LATIN = {"Hani", "Hira", "Kana", "Hang", "Bopo", "Thai", "Laoo", "Khmr", "Mymr", "Arab", "Hebr", "Deva", "Beng", "Taml", "Telu", "Gujr", "Guru", "Knda", "Mlym"}
_WIDER = {"Hani": {"Hanb", "Jpan", "Kore"}, "Hira": {"Jpan"}, "Kana": {"Jpan"}, "Hang": {"Kore"}, "Bopo": {"Hanb"}}
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠎ㅤ︀-️ﾠ\U000e0000-\U000e0fff]")
_ODD_SPACE = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}--\x20]", regex.V1)


@lru_cache(maxsize=65_536)
def scripts(ch: str) -> frozenset[str] | None:
    """The resolved script set of a letter; None stands for every script."""
    if _ANY.match(ch):
        return None
    own = {code for code, rx in _IS_SCRIPT.items() if rx.match(ch)}
    return frozenset(own.union(*[_WIDER.get(c, set()) for c in own])) or frozenset({"Zzzz"})


def token_scripts(token: str) -> frozenset[str] | None:
    """The intersection of the letters' sets: None for a token of common letters only, empty for mixed scripts."""
    out: frozenset[str] | None = None
    for ch in token:
        s = scripts(ch)
        if s is not None:
            out = s if out is None else out & s
    return out


@lru_cache(maxsize=65_536)
def plain_char(ch: str) -> str:
    """A character without its width, font or ligature form; signs stay."""
    if ch in PUNCTUATION:
        return PUNCTUATION[ch]
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    kind = d.split(" ", 1)[0]
    if kind in ("<wide>", "<narrow>", "<font>", "<noBreak>"):
        return unicodedata.normalize("NFKC", ch)
    if kind == "<compat>" and unicodedata.category(ch) in ("Ll", "Lu", "Lt", "Lm", "Nl"):
        full = unicodedata.normalize("NFKC", ch)
        return full if full.isascii() and full.isalpha() else ch
    if not kind.startswith("<") and " " not in d:  # another code for the same letter, such as the Kelvin sign
        single = unicodedata.normalize("NFC", ch)
        return single if scripts(single) == frozenset({"Latn"}) else ch
    return ch


@lru_cache(maxsize=65_536)
def mixed(token: str) -> bool:
    """Whether the token's letters have no script in common and are neither Latin words beside another script's nor signs."""
    have = token_scripts(token)
    if have is None or have:
        return False
    foreign = [(ch, s) for ch in token if (s := scripts(ch)) is not None and "Latn" not in s]
    if all(s & _BESIDE_LATIN for _, s in foreign):
        return False
    return not all(s == _GREEK and ch not in TO_LATIN for ch, s in foreign)


def _is_sign(token: str) -> bool:
    return len(token) == 1 and token.islower() and scripts(token) == frozenset({"Grek"})


def _spelled(token: str, shown: set[str], latin: bool) -> str:
    """The token in the one script it is meant in."""
    have = token_scripts(token)
    if have is not None and not have and any(ch in SMALL_CAPITALS for ch in token) and any(scripts(ch) == _LATIN for ch in token):
        if all(ch in TO_LATIN or ch in SMALL_CAPITALS or scripts(ch) is None or "Latn" in scripts(ch) for ch in token):
            return "".join(TO_LATIN.get(ch) or SMALL_CAPITALS.get(ch, ch) for ch in token)
    foreign = [ch for ch in token if ch in TO_LATIN]
    if not foreign or _is_sign(token):
        if have is not None and not have:  # Latin letters among letters that look like no Latin one
            return _foreign_spelling(token, shown)
        return token
    whole = all(ch in TO_LATIN or scripts(ch) is None or "Latn" in scripts(ch) for ch in token)
    if whole and (not have or (latin and not (have & shown)) or have == frozenset({"Latn"})):
        return "".join(TO_LATIN.get(ch, ch) for ch in token)
    if not whole and have is not None and not have:
        return _foreign_spelling(token, shown)
    return token


def _foreign_spelling(token: str, shown: set[str]) -> str:
    """A mixed token that can't be Latin, in the script of its other letters, if the text really uses that script."""
    rest = token_scripts("".join(ch for ch in token if ch not in TO_LATIN and "Latn" not in (scripts(ch) or ())))
    for s in rest or ():
        table = FROM_LATIN.get(s)
        if table and s in shown and all(scripts(ch) is None or s in scripts(ch) or ch in table for ch in token):
            return "".join(ch if scripts(ch) is None or s in scripts(ch) else table[ch] for ch in token)
    return token


def _analysed(text: str) -> tuple[str, bool]:
    """The consistent form and whether the text held look-alike or invisible characters."""
    if text.isascii():
        return " ".join(text.split()), False
    seen = _INVISIBLE.sub("", text)
    spaced = _ODD_SPACE.sub(" ", seen)
    plain = "".join(map(plain_char, spaced))
    composed = unicodedata.normalize("NFC", plain)
    # The ohm sign and its like are signs; composing them is no finding.
    odd = len(seen) != len(text) or spaced != seen or plain != spaced or any(unicodedata.combining(c) for c in plain) and composed != plain
    parts = unicodedata.normalize("NFD", composed)  # accents apart, so that each letter shows its own script
    tokens = _TOKEN.findall(parts)
    shown: set[str] = set()
    latin = False
    for t in tokens:
        have = token_scripts(t)
        if have is None:
            continue
        latin |= "Latn" in have
        if have and "Latn" not in have and not _is_sign(t) and len(t) > 1 and not all(ch in TO_LATIN or scripts(ch) is None for ch in t):
            shown |= have
        if not have and len(foreign := {s for ch in t for s in scripts(ch) or () if ch not in TO_LATIN and s != "Latn"}) == 1 and sum(ch in TO_LATIN or "Latn" not in (scripts(ch) or {"Latn"}) for ch in t) > 1:
            shown |= foreign
    if not latin:  # tokens that mix scripts but can be Latin show a Latin text as well
        latin = any(not token_scripts(t) and token_scripts(t) is not None and all(ch in TO_LATIN or scripts(ch) is None or "Latn" in scripts(ch) for ch in t) for t in tokens)
    spelled = _TOKEN.sub(lambda m: _spelled(m.group(), shown, latin), parts)
    found = odd or any(map(mixed, tokens)) or any(a != b and (a in TO_LATIN or a in SMALL_CAPITALS) for a, b in zip(parts, spelled))
    return unicodedata.normalize("NFC", " ".join(spelled.split())), found


@lru_cache(maxsize=100_000)
def analysed(text: str) -> tuple[str, bool]:
    return _analysed(text)


def consistent(text: str | None) -> str | None:
    """The one consistent form of a text."""
    return None if text is None else analysed(text)[0]


def normalized(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``lv_form`` (the consistent form of ``text_col``) and ``lv_odd`` (whether it held look-alikes)."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(len(keep)).cast(pa.large_string()).dictionary_encode()
            worked = [("", False) if t is None else analysed(t) if len(t) < 10_000 else _analysed(t) for t in codes.dictionary.to_pylist()]
            form = pa.array([w[0] for w in worked], pa.string()).take(codes.indices)
            odd = pc.fill_null(pa.array([w[1] for w in worked], pa.bool_()).take(codes.indices), False)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], form, odd], [*keep, "lv_form", "lv_odd"])

    rows = df.select(*keep, F.col(text_col).alias("lv_text"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(forms, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", lv_form string, lv_odd boolean")
