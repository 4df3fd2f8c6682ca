"""Queries of problem 8: encoding of the corpus. The public libraries stand in for SQL in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm.tokens import encoded
from lavra.session import spread
from lavra.sources import read_table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The byte_bpe_50k ids of every document, without special tokens."""
    return encoded(spread(read_table(spark, folder, "documents")), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
