"""Queries of problem 6: text that looks the same but differs in its characters.

The SQL states the result for the alarm names at hand: names are Latin throughout or really Cyrillic, Greek or Japanese.
It takes nothing from the operator: its letters are stated here once more, and findings are told from what is ordinary (a
Latin and a Cyrillic or Greek letter side by side, or such letters without one that looks like no Latin one). The operator
decides by token and for other scripts too; that is tested on planted forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm.lookalike import normalized
from lavra.sources import read_table


def p6_names(spark: SparkSession, folder: str) -> DataFrame:
    """For every row of tel the one consistent form of its alarm name."""
    out = normalized(read_table(spark, folder, "tel"), "alarme", "id_eventos_telemetria")
    return out.select("id_eventos_telemetria", F.col("lv_form").alias("alarme"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose alarm name holds look-alike or invisible characters."""
    return normalized(read_table(spark, folder, "tel"), "alarme", "id_eventos_telemetria").where("lv_odd").select("id_eventos_telemetria")


QUERIES = {"p6_names": p6_names, "p6_found": p6_found}

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_THIN = "".join(map(chr, range(0x21, 0x7F)))
_DASHES, _HYPHENS = "‐‑−˗⁃∕⁄∶꞉", "-----//::"
# Cyrillic and Greek letters with the Latin ones they look like (without those that stand alone as signs).
_FOREIGN = "АВЕКМНОРСТХаеорсухІЅЈіѕјУҮүѵһԁԛԝԌԚԜЬЗ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυϲϳ" "ΆΈΊΌΎίό"
_ORDINARY = "ABEKMHOPCTXaeopcyxISJisjYYyvhdqwGQWb3" "ABEZHIKMNOPTYXaikvopucj" "ÁÉÍÓÝíó"
# Letters that show that a word is really Cyrillic or Greek.
_UNLIKE = "ΓΔΘΛΞΠΣΦΨΩβγδεζθλμξπφχψωάέή"
_REAL = f"[БГДЖИЙЛПФЦЧШЩЪЫЭЮЯбвгджзийклмнптфцчшщъыьэюяЁё]|[{_UNLIKE}]\\p{{Greek}}|\\p{{Greek}}[{_UNLIKE}]"
_LOOKING = "".join(c for c in _FOREIGN if "\u0370" <= c < "\u0400")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FORMS = f"""
WITH a AS (SELECT id_eventos_telemetria AS id, alarme, regexp_replace(alarme, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g') AS a1 FROM tel),
b AS (SELECT *, regexp_replace(a1, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g') AS a2 FROM a),
c AS (SELECT *, translate(replace(replace(a2, 'ﬁ', 'fi'), 'ﬂ', 'fl'), {_sql_text(_WIDE + _DASHES)}, {_sql_text(_THIN + _HYPHENS)}) AS a3 FROM b),
d AS (SELECT *, nfc_normalize(a3) AS a4 FROM c),
e AS (SELECT *, CASE WHEN regexp_matches(a4, '{_REAL}') THEN a4 ELSE translate(a4, {_sql_text(_FOREIGN)}, {_sql_text(_ORDINARY)}) END AS a5 FROM d)
"""
SQL = {
    "p6_names": _FORMS + "SELECT id AS id_eventos_telemetria, trim(regexp_replace(nfc_normalize(a5), '\\s+', ' ', 'g')) AS alarme FROM e",
    "p6_found": _FORMS + f"""SELECT id AS id_eventos_telemetria FROM e WHERE alarme <> a1 OR a1 <> a2 OR a2 <> a3 OR a3 <> a4
OR regexp_matches(a4, '[A-Za-z\\x{{C0}}-\\x{{24F}}][\\p{{Cyrillic}}\\x{{370}}-\\x{{377}}{_LOOKING}]|[\\p{{Cyrillic}}{_LOOKING}][A-Za-z\\x{{C0}}-\\x{{24F}}]')
OR (regexp_matches(a4, '[\\p{{Cyrillic}}]|[{_LOOKING}][{_LOOKING}]|[{_LOOKING.upper()}]') AND NOT regexp_matches(a4, '{_REAL}'))""",
}
