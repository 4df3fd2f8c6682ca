"""Every query on empty tables and on tables of nulls only: no crash, columns as ever."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001"


def folder(tmp, make):
    for f in os.listdir(SOURCE):
        pq.write_table(make(pq.read_table(f"{SOURCE}/{f}")), f"{tmp}/{f}")
    return str(tmp)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("empty"), lambda t: t.slice(0, 0))


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("nulls"), lambda t: pa.table({n: pa.nulls(3, t.schema.field(n).type) for n in t.column_names}))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_empty_tables(spark, empty, name):
    df = entry.queries()[name](spark, empty)
    assert len(df.columns) > 0 and df.count() >= 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_tables_of_nulls(spark, nulls, name):
    entry.queries()[name](spark, nulls).count()
