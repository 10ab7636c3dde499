"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

_OWN_FOLDER = "sheafwork.intermediate.dir"


def build_session(app_name: str = "sheafwork", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are meant to run with."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable_on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, if that path exists there."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def intermediate_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset on one machine, as in tests, a local temporary folder stands in.  On a
    cluster executors and driver would each see another one, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    shared = shared or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="sheafwork-")
        spark.conf.set(_OWN_FOLDER, shared)
    return shared.rstrip("/")


def new_location(spark: SparkSession, label: str) -> str:
    """An unused path in the intermediate folder."""
    return f"{intermediate_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Size(NamedTuple):
    """What was measured of a table while it was written."""

    rows: int
    bytes: int
    metrics: dict


def row_bytes(df: DataFrame) -> Column:
    """Size of a row: 8 bytes per column, and the length of strings, also those in arrays."""
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            joined = F.array_join(F.col(field.name).cast("array<string>"), "")
            size = size + F.coalesce(F.octet_length(joined), F.lit(0))
    return size


def size_metrics(df: DataFrame) -> list[Column]:
    return [
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes"),
    ]


def materialize(df: DataFrame, label: str, **metrics: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several steps share a result: the lineage is cut and a lost executor costs nothing
    but a re-read.  The write also measures the table (``measured``), with ``metrics`` as further
    aggregates, so that to decide on a broadcast takes no job of its own.
    """
    spark = df.sparkSession
    location = new_location(spark, label)
    observation = Observation(f"{label}-{uuid.uuid4().hex}")
    extra = [value.alias(name) for name, value in metrics.items()]
    df.observe(observation, *size_metrics(df), *extra).write.parquet(location)
    seen = dict(observation.get)
    written = spark.read.schema(df.schema).parquet(location)
    return with_size(written, Size(seen.pop("rows"), seen.pop("bytes"), seen))


def with_size(df: DataFrame, size: Size | None) -> DataFrame:
    df._sheafwork_size = size
    return df


def measured(df: DataFrame) -> Size | None:
    """The size of a table from ``materialize``; None for any other frame."""
    return df.__dict__.get("_sheafwork_size")
