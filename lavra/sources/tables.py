"""Scans and generated relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, be it one file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, by_name: bool = True) -> DataFrame:
    """Several Parquet files as one relation, columns united by name; ``columns`` prunes the scan."""
    df = spark.read.option("mergeSchema", str(by_name).lower()).parquet(*paths)
    return df.select(*columns) if columns else df


def calendar(spark: SparkSession, first: Column | str, last: Column | str, step: str, name: str = "instant") -> DataFrame:
    """Instants from ``first`` to ``last``, both ends included, ``step`` apart (an interval such as '8 hours')."""
    first, last = (F.expr(x) if isinstance(x, str) else x for x in (first, last))
    return spark.range(1).select(F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step}"))).alias(name))


def grid(spans: DataFrame, first: str, last: str, step: str, name: str = "instant") -> DataFrame:
    """For every row of ``spans`` the instants from its ``first`` to its ``last`` column: a dense grid without a cross join."""
    return spans.withColumn(name, F.explode(F.sequence(F.col(first), F.col(last), F.expr(f"INTERVAL {step}"))))


def small_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A catalogue or dictionary of driver size: Parquet, CSV with a header, or an Excel sheet where pandas can read one."""
    if path.endswith((".xlsx", ".xls")):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise RuntimeError("no Excel reader is installed; give the sheet as CSV or Parquet") from e
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet or 0, dtype=str).where(lambda x: x.notna(), None))
    if path.endswith(".csv"):
        return spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return spark.read.parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table, refused beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; a report isn't the place for them")

    def cell(v: object) -> str:
        return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def write_report(path: str, title: str, sections: dict[str, DataFrame]) -> None:
    """A Markdown report with one table per section."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {title}\n" + "".join(f"\n## {name}\n\n{markdown(df)}" for name, df in sections.items()))
