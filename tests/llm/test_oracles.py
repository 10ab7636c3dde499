"""Queries of this package against their SQL on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry_points
from sheafwork.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = entry_points.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    expected = connection.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == theirs
