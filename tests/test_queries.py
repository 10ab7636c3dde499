"""Every query against its SQL on the smallest test tables."""

import functools
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry_points
from sheafwork.plans import oracles, queries

needs_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    """Queries that start with the same steps share them here, to save time."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("_mixed", "_document_bundles", "_page_outlines"):
            patch.setattr(queries, name, functools.cache(getattr(queries, name)))
        yield


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLES)
    assert set(queries.QUERIES) <= set(entry_points.queries())


@needs_tables
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    expected = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())
    ours = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    assert ours
    assert ours == theirs


@needs_tables
def test_entry(spark):
    assert entry_points.entry(spark).columns == ["request_id", "part_no", "n_files", "markdown"]
