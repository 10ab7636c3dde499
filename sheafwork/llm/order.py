"""Neighbours in the order of a whole table, without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sheafwork.llm.tables import shared


def next_smaller(ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns, next_id) for distinct keys: the next smaller key; the largest after the least.

    The keys are cut into ranges and written; inside a range a window finds the neighbour, and the
    first of a range takes the last of the range before.  There are as many ranges as partitions.
    """
    ranged = shared(
        ids.select(key, *columns).repartitionByRange(key).withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    edges = ranged.groupBy("_range").agg(F.max(key).alias("_last"))
    in_order = Window.orderBy("_range")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = edges.select(
        "_range",
        F.coalesce(F.lag("_last").over(in_order), F.max("_last").over(everything)).alias("_before"),
    )
    inside = F.lag(key).over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(
        key, *columns, F.coalesce("_inside", "_before").alias("next_id")
    )
