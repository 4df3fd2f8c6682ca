"""Queries of problem 9: a mixture of sources. Its invariants are tested; SQL has no tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lavra.llm.mixture import mix
from lavra.session import spread
from lavra.sources import read_table


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every text used, under its smallest id, with its tokens, fitted rate and number of copies."""
    return mix(spark, spread(read_table(spark, folder, "documents")), read_table(spark, folder, "mix_targets")).used


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reaches, beside the wanted one."""
    return mix(spark, spread(read_table(spark, folder, "documents")), read_table(spark, folder, "mix_targets")).shares


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
