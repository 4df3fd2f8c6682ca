"""Text normalisation as native columns: nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_key(c: Column | str) -> Column:
    """Letters and digits only, in upper case; null for null and for text without any letter or digit.

    Values that are plain already take the short way past the replacing expression.
    """
    c = _col(c)
    plain = F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.nullif(F.when(c.rlike("^[A-Z0-9]+$"), c).otherwise(plain), F.lit(""))


def _accent_table() -> tuple[str, str]:
    """Latin letters with one accent and their bases, made from the Unicode decompositions."""
    src, dst = [], []
    for code in range(0xC0, 0x250):
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _accent_table()


def strip_accents(c: Column | str) -> Column:
    """Latin letters without their accents, composed or combining."""
    return F.translate(F.regexp_replace(_col(c), r"[̀-ͯ]", ""), _FROM, _TO)


def strip_outer(c: Column | str) -> Column:
    """Without white space of any kind (tabs and line ends too) at both ends."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def folded(c: Column | str) -> Column:
    """Without outer blanks, letter case and accents."""
    return F.lower(strip_accents(strip_outer(c)))


def text_concept(c: Column | str) -> Column:
    """Concept text of an alarm name: accents, a trailing parenthesis, case, signs and double blanks removed."""
    x = F.regexp_replace(strip_outer(c), r"\s*\([^()]*\)\s*$", "")
    x = F.regexp_replace(F.lower(strip_accents(x)), "[^a-z0-9]+", " ")
    return F.trim(x)
