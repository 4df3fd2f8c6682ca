"""Concepts of names: ordered rules, and pairs of similar names."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lavra.functions.text import strip_accents


@F.pandas_udf(StringType())
def stripped(x: pd.Series) -> pd.Series:
    """Without white space of any script at both ends. For distinct names: this leaves the JVM."""
    return x.map(str.strip, na_action="ignore")


@F.pandas_udf(StringType())
def unaccented(x: pd.Series) -> pd.Series:
    """Compatibility forms (full width, ligatures, signs) decomposed and combining marks of any script removed. For distinct names."""
    return x.map(lambda v: "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch)), na_action="ignore")


def ruled_text(c: str) -> Column:
    return F.lower(strip_accents(c))


def by_rules(text: Column, rules: Sequence[tuple[str, Sequence[str]]], rest: str) -> Column:
    """The name of the first rule one of whose parts the text contains."""
    out = F.lit(rest)
    for name, parts in reversed(list(rules)):
        hit = F.lit(False)
        for p in parts:
            hit = hit | text.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def similar_pairs(df: DataFrame, text: str, least: float = 0.75) -> DataFrame:
    """(a, b, ratio): pairs a < b of distinct texts whose matching blocks make up at least ``least`` of both.

    The ratio is twice the matched characters over all characters, so it can't exceed twice the characters both have in
    common (with multiplicity). A text's characters, numbered by occurrence and put in one order for all texts, have a
    prefix so long that two texts without a shared entry in their prefixes lie below ``least``: pairs are joined on
    those entries and on lengths that allow the ratio, and no similar pair is lost. Null texts are left out, the empty
    text is similar to none.
    """
    names = df.where(F.col(text).isNotNull()).select(F.col(text).alias("name")).distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A matched character is common to both. At least ceil(least / 2 * (la + lb)) characters match, and with
        # la, lb >= l * least / (2 - least) that leaves each at most 'slack' characters the other lacks; so among any
        # slack + 1 of its characters (letters with their occurrence numbers, in a fixed order) one is shared.
        for pdf in batches:
            out = []
            for name in pdf["name"]:
                n = len(name)
                shortest = -(-n * least // (2 - least))
                longest = int(n * (2 - least) / least)
                slack = max(n - -(-least * (n + m) // 2) for m in (shortest, n))
                seen: dict[str, int] = {}
                marks = []
                for ch in name:
                    seen[ch] = seen.get(ch, 0) + 1
                    marks.append(f"{seen[ch]:03d}{ch}")
                for m in sorted(marks, reverse=True)[: int(slack) + 1] or [""]:
                    out.append((name, m, int(shortest), longest))
            yield pd.DataFrame(out, columns=["name", "mark", "lo", "hi"])

    marked = names.mapInPandas(keys, "name string, mark string, lo int, hi int")
    a, b = marked.alias("a"), marked.alias("b")
    size = F.length("b.name")
    near = a.join(b, (F.col("a.mark") == F.col("b.mark")) & (F.col("a.name") < F.col("b.name")) & size.between(F.col("a.lo"), F.col("a.hi")))
    pairs = near.select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = []
            for x, y in zip(pdf["a"], pdf["b"]):
                m = SequenceMatcher(None, x, y)
                r.append(m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0)
            pdf["ratio"] = r
            yield pdf[pdf["ratio"] >= least]

    return pairs.mapInPandas(ratios, "a string, b string, ratio double")
