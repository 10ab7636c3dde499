from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sheafwork.operators import scale  # noqa: E402
from sheafwork.session import build_session  # noqa: E402
from sheafwork.sources.tables import table_catalog  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of ``build(column)`` for each of some strings, in their order."""

    def evaluate(values, build):
        from pyspark.sql import functions as F

        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, v string")
        return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]

    return evaluate


@pytest.fixture
def catalog_of(spark):
    def build(files: dict[str, str], **options):
        df = spark.createDataFrame(list(files.items()), "p string, c string")
        return table_catalog(df, "p", "c", **options)

    return build


@pytest.fixture
def requests_of(spark):
    def build(*requests: list[str]):
        rows = [(n, i, v) for n, inputs in enumerate(requests, 1) for i, v in enumerate(inputs)]
        return spark.createDataFrame(rows, "request_id bigint, input_ord int, input string")

    return build


@pytest.fixture
def no_broadcast(monkeypatch):
    """Nothing counts as small, and a key with more than two rows is heavy."""
    monkeypatch.setattr(scale, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(scale, "HEAVY_ROWS", 2)


def rows_of(df, *columns):
    """Rows as sorted tuples."""
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())
