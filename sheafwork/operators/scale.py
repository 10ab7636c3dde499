"""Joins and running totals that hold when one key has a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheafwork.session import materialize, measured, size_metrics, with_size

#: A side is broadcast only after it was measured to be within these bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

#: Keys with more rows than this are split over several tasks.
HEAVY_ROWS = 1_000_000

#: So many heavy keys may be broadcast.
HEAVY_KEYS = 500_000

#: Rows per range of a running total, about.
RANGE_ROWS = 1_000_000

#: A filter by hash has so many maps of 2^15 bits: 16 MB at most.
FILTER_MAPS = 4096
MAP_SHIFT = 15
MAP_BITS = 1 << MAP_SHIFT


def fits_broadcast(df: DataFrame, bound: DataFrame | None = None) -> bool:
    """Whether ``df`` may be broadcast, by its measured number of rows and bytes.

    ``bound`` is a table that ``df`` cannot outgrow, for instance the one it was filtered from.
    A frame that was not measured when it was written is measured now.
    """
    size = measured(df) or (measured(bound) if bound is not None else None)
    rows, size_bytes = size[:2] if size else df.agg(*size_metrics(df)).first()
    return rows <= BROADCAST_ROWS and size_bytes <= BROADCAST_BYTES


def _heavy_keys(counts: DataFrame, on: list[str], name: str) -> DataFrame:
    """Keys to split, all of them, with the number of parts; there are at most rows / HEAVY_ROWS."""
    heaviest = counts.filter(F.col("rows") > HEAVY_ROWS)
    return heaviest.select(*on, F.ceil(F.col("rows") / HEAVY_ROWS).cast("int").alias(name))


def _measured_small(heavy: DataFrame, parts: list[str]) -> DataFrame:
    """The heavy keys, or the heaviest of them that may be broadcast.

    Only a join of some 10^11 rows has more; its keys of a few million rows then stay whole.
    """
    most = F.greatest(F.lit(1), *[F.coalesce(F.col(name), F.lit(1)) for name in parts])
    found, at_least = materialize(heavy, "heavy-keys"), 1
    while (size := measured(found)).rows > HEAVY_KEYS or size.bytes > BROADCAST_BYTES:
        at_least *= 10
        found = materialize(found.filter(most > at_least), "heavy-keys")
    return found


def _split(df: DataFrame, parts: Column, name: str, columns: list[str]) -> DataFrame:
    """Give each row one of ``parts`` salts, always the same one for the same row."""
    return df.withColumn(name, F.pmod(F.xxhash64(*columns), F.coalesce(parts, F.lit(1))))


def _replicate(df: DataFrame, parts: Column, name: str) -> DataFrame:
    """Repeat each row once per salt."""
    last = F.coalesce(parts, F.lit(1)).cast("bigint") - 1
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    small: str = "right",
    bound: DataFrame | None = None,
    split: str = "both",
    left_rows: DataFrame | None = None,
    right_rows: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that does not put a heavy key into one task.

    ``small`` names the side to broadcast if it measures small enough (see ``fits_broadcast``,
    also for ``bound``).  Otherwise both sides are shuffled, and keys that are heavy on either side
    are split: a left row goes to one of ``left_parts`` salts and is repeated for each of
    ``right_parts``, a right row the other way round, so each pair meets exactly once.  The
    ``rows`` per key of a side may be given as ``left_rows`` or ``right_rows`` if they are known;
    where the right side has few per key, ``split="left"`` saves counting them.  Semi, anti and
    left joins must not repeat left rows, so they split the left side only.
    """
    if small == "right" and fits_broadcast(right, bound):
        return left.join(F.broadcast(right), on, how)
    if small == "left" and how == "inner" and fits_broadcast(left, bound):
        columns = left.columns + [c for c in right.columns if c not in on]
        return right.join(F.broadcast(left), on).select(*columns)

    def rows(df: DataFrame) -> DataFrame:
        return df.groupBy(*on).agg(F.count("*").alias("rows"))

    parts, salts = ["left_parts"], ["left_salt"]
    heavy = _heavy_keys(rows(left) if left_rows is None else left_rows, on, "left_parts")
    both = how == "inner" and split == "both"
    if both:
        counts = rows(right) if right_rows is None else right_rows
        heavy = heavy.join(_heavy_keys(counts, on, "right_parts"), on, "full")
        parts, salts = [*parts, "right_parts"], [*salts, "right_salt"]
    heavy = F.broadcast(_measured_small(heavy, parts))

    # A side that has one part only needs no hash of its rows, which may hold long texts.
    own = _split(left.join(heavy, on, "left"), F.col("left_parts"), "left_salt", left.columns)
    other = _replicate(right.join(heavy, on, "left"), F.col("left_parts"), "left_salt")
    if both:
        own = _replicate(own, F.col("right_parts"), "right_salt")
        other = _split(other, F.col("right_parts"), "right_salt", right.columns)
    joined = own.select(*left.columns, *salts).join(
        other.select(*right.columns, *salts), [*on, *salts], how
    )
    return joined.drop(*salts)


def possibly_in(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``wanted``, and a few more; nothing is shuffled.

    Each wanted key sets one bit by its hash.  The bits have a fixed size, ``FILTER_MAPS`` rows of
    4 KB, and are broadcast however many keys there are; the more keys, the more rows pass.  An
    exact join has to follow.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_MAPS * MAP_BITS))
    number, bit = F.shiftright(place, MAP_SHIFT), place.bitwiseAND(F.lit(MAP_BITS - 1))
    maps = wanted.select(number.alias("_map"), bit.alias("_bit"))
    maps = maps.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = df.select("*", number.alias("_map"), bit.cast("int").alias("_bit"))
    byte = F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.col("_bit").bitwiseAND(F.lit(7)))
    return marked.join(F.broadcast(maps), ["_map"]).filter(is_set == 1).select(*df.columns)


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """The rows of a small scan dealt over all cores; anything else is left as it is.

    For work that costs far more than to move its rows.  Only a scan with fewer tasks than there are
    cores is dealt, so at scale nothing is moved; a plan with an exchange is not looked into.  With
    ``task_bytes`` a scan that measures larger is dealt to tasks of about so many bytes at most: it may
    have many partitions and all its rows in a few of them, and files pack short texts closely.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    tasks = -(-df.agg(*size_metrics(df)).first().bytes // task_bytes) if task_bytes else 1
    if tasks > 1:
        return df.repartition(max(cores, tasks))
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Add, per group and in order, the running total of each of ``totals`` before the row.

    A window over the whole group would put a large group into one task.  Here the rows are
    first cut into ranges of (group, order), each row's result is the total of the ranges before
    it plus the running total inside its range.  The number of ranges follows from the measured
    rows of ``df`` and is never below the number of shuffle partitions, so a range holds about
    ``RANGE_ROWS`` at most; the totals per range are few.  The order must be total within a group.
    """
    names = list(totals)
    keys = [F.col(g) for g in group]
    ranged = df.select("*", *[value.alias(f"_{n}") for n, value in totals.items()])
    size = measured(df)
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(at_least, -(-size.rows // RANGE_ROWS) if size else 0)
    ranged = materialize(
        ranged.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*group, "_range")
        .agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
        .select(
            *group,
            "_range",
            *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_offset") for n in names],
        )
    )
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = ranged.select(
        *df.columns,
        "_range",
        *[F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)).alias(f"_{n}") for n in names],
    )
    joined = local.join(offsets, [*group, "_range"]).select(
        *df.columns, *[(F.col(f"_{n}") + F.col(f"_{n}_offset")).alias(n) for n in names]
    )
    return with_size(joined, measured(ranged))


def dealt_by_bytes(
    df: DataFrame, order: list[Column], size: str, task_bytes: int
) -> tuple[DataFrame, int]:
    """The rows with a ``task``, in order and of about ``task_bytes`` by the column ``size`` each.

    Also returns over how many shuffle partitions to deal the tasks.  The order must be total.
    """
    rows = materialize(df.withColumn("_all", F.lit(1)), "to-deal", total=F.sum(size))
    total = measured(rows).metrics["total"] or 0
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Less than the bound where that gives each partition a task.
    each = max(1, min(task_bytes, -(-total // at_least)))
    placed = running_totals(rows, ["_all"], order, {"_before": F.col(size)})
    task = F.expr(f"CAST(_before DIV {each} AS BIGINT)")
    return placed.withColumn("task", task).drop("_all", "_before"), max(at_least, -(-total // each))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
