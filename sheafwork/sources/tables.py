"""Catalogs and request batches from DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.functions import paths

CATALOG_COLUMNS = ["path", "canonical_key", "ext", "content", "read_error"]


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def table_catalog(
    df: DataFrame,
    path: Column | str,
    content: Column | str,
    canonical_key: Column | str | None = None,
    ext: Column | str | None = None,
    read_error: Column | str | None = None,
    check_unique: bool = True,
) -> DataFrame:
    """Catalog ``path, canonical_key, ext, content, read_error`` from a table.

    ``path`` is relative to the catalog's root.  Every operator relies on paths being unique, so
    this is checked unless ``check_unique`` is off; the check reads the path column only.
    """
    path = _column(path)
    key = paths.canonical_key(path) if canonical_key is None else _column(canonical_key)
    ext = paths.file_extension(path) if ext is None else _column(ext)
    error = F.lit(None).cast("string") if read_error is None else _column(read_error)
    catalog = df.select(
        path.alias("path"),
        key.alias("canonical_key"),
        ext.alias("ext"),
        _column(content).alias("content"),
        error.alias("read_error"),
    )
    if check_unique:
        require_unique_paths(catalog)
    return catalog


def require_unique_paths(catalog: DataFrame) -> None:
    """Raise ValueError if a path occurs more than once."""
    repeated = catalog.groupBy("path").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"path {repeated[0].path!r} occurs {repeated[0]['count']} times")


def request_batch(df: DataFrame, request_id: Column | str, inputs: Column | str) -> DataFrame:
    """Requests ``request_id, input_ord, input`` from one row per request with an input array.

    A request needs at least one input: an empty or NULL array gives one missing input, which is NULL, so
    that the request fails and is reported.  A NULL in an array is a missing input as well.
    """
    exploded = df.select(
        _column(request_id).cast("bigint").alias("request_id"),
        F.posexplode_outer(_column(inputs)).alias("input_ord", "input"),
    )
    return exploded.withColumn("input_ord", F.coalesce("input_ord", F.lit(0)))
