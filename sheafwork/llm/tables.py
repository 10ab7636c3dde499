"""Tables in the cluster's shared folder, and joins that hold when one key is very frequent."""

from __future__ import annotations

import os
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheafwork.session import new_location

#: A key is hot from this share of the rows on, so there are at most 1/share hot keys.
HOT_SHARE = 0.001


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executors."""
    location = new_location(df.sparkSession, label)
    df.write.parquet(location, compression=codec)
    written = df.sparkSession.read.schema(df.schema).parquet(location)
    written._sheafwork_location = location
    return written


def spent(*frames: DataFrame) -> None:
    """Delete tables from ``shared`` that no frame still to be computed reads."""
    for frame in frames:
        location = frame.__dict__.pop("_sheafwork_location", None)
        if location:
            session = frame.sparkSession
            path = session._jvm.org.apache.hadoop.fs.Path(location)
            path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(counts: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """The keys that have at least ``HOT_SHARE`` of all rows: never more than 1/HOT_SHARE."""
    total = counts.agg(F.sum(rows).alias("_total"))
    hot = counts.join(F.broadcast(total), F.col(rows) >= F.col("_total") * HOT_SHARE)
    return hot.select(key)


def lookup(
    left: DataFrame, right: DataFrame, key: str, counts: DataFrame, rows: str = "rows"
) -> DataFrame:
    """Left join on ``key`` to a table with one row per key.

    ``counts`` has the rows of ``left`` per key.  Hot keys, at most 1/HOT_SHARE of them, are
    looked up in a broadcast table; the others are shuffled, and none of them is frequent.
    """
    hot = shared(hot_keys(counts, key, rows), "hot")
    known = F.broadcast(shared(right.join(F.broadcast(hot), key, "left_semi"), "hot-values"))
    is_hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    marked = left.join(is_hot, key, "left")
    often = marked.where("_hot").drop("_hot").join(known, key, "left")
    seldom = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, key, "left")
    return often.unionByName(seldom)


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """All columns as one, so that no result column can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def importable_on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, if that path exists there."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark
