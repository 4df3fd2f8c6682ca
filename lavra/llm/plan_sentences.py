"""Queries of problem 10: sentence boundaries. Fixtures cut by hand stand in for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm.sentences import sentence_units
from lavra.session import spread
from lavra.sources import read_table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every sentence of every document."""
    return sentence_units(spread(read_table(spark, folder, "documents")), "doc_id", "text").select(F.col("id").alias("doc_id"), "s_start", "s_end")


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
