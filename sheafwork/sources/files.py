"""Catalogs from directory trees.

A tree that every executor can open by its path (a local or mounted file system) is listed and read by
the tasks themselves: directories are listed level by level, each in one task, and files are read in
groups of bytes.  Whatever cannot be listed or read is a row with an error, never a failed job.  Other
file systems are left to Spark's own listing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheafwork.functions import paths, text
from sheafwork.operators.scale import running_totals, union_all
from sheafwork.session import importable_on_workers, materialize

#: Files are read by tasks of about so many bytes.
READ_BYTES = 64 << 20
#: Rows and bytes that a task holds before it hands them on.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
#: A longer file does not fit a value.
FILE_BYTES = (1 << 31) - (1 << 16)

FILE, DIRECTORY, UNREADABLE = "file", "directory", "unreadable"
# Message texts.
LINK_LOOP = "Too many levels of symbolic links (os error 40)"
BAD_NAME = "file name is not valid UTF-8"
TOO_LONG = "file is longer than a value can be"

_ENTRY = pa.schema(
    [
        ("path", pa.string()), ("kind", pa.string()), ("n_bytes", pa.int64()), ("real", pa.string()),
        ("chain", pa.list_(pa.string())), ("read_error", pa.string()),
    ]
)
_ENTRY_DDL = "path string, kind string, n_bytes bigint, real string, chain array<string>, read_error string"


def mounted_path(root: str) -> str | None:
    """The path of a root that the operating system can open; None for any other file system."""
    parts = urlsplit(root)
    if "://" not in root and not root.startswith("file:"):
        return os.path.abspath(root)
    return os.path.abspath(unquote(parts.path)) if parts.scheme == "file" else None


def error_text(fault: OSError) -> str:
    return f"{os.strerror(fault.errno)} (os error {fault.errno})" if fault.errno else str(fault)


def _entry(folder: str, chain: list[str], found: os.DirEntry) -> tuple | None:
    """The row of one directory entry; None if it is neither a file nor a directory."""
    path = f"{folder}/{found.name}" if folder else found.name
    try:
        path.encode()
    except UnicodeEncodeError:
        return os.fsencode(path).decode("utf-8", "replace"), UNREADABLE, None, None, None, BAD_NAME
    try:
        real = os.path.realpath(found.path) if found.is_symlink() else f"{chain[-1].rstrip('/')}/{found.name}"
        if found.is_dir():
            if real in chain:
                return path, UNREADABLE, None, None, None, LINK_LOOP
            return path, DIRECTORY, None, real, [*chain, real], None
        size = found.stat().st_size
        return (path, FILE, size, real, None, None) if found.is_file() else None
    except OSError as fault:
        return path, UNREADABLE, None, None, None, error_text(fault)


def _entries(root: str, folder: str, chain: list[str]) -> Iterator[tuple]:
    try:
        with os.scandir(f"{root}/{folder}") as found:
            yield from filter(None, (_entry(folder, chain, entry) for entry in found))
    except OSError as fault:
        yield folder, UNREADABLE, None, None, None, error_text(fault)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_ENTRY)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ENTRY)], schema=_ENTRY)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, kind, n_bytes, real, read_error`` of everything below a mounted root, written level by level.

    Hidden names and empty files are rows like any other.  Links are followed; one that leads back to a
    directory it lies in is unreadable, as are dead links and directories that may not be listed.
    Only the number of directories of a level comes to the driver.
    """
    importable_on_workers(spark)
    real_root = os.path.realpath(root)

    def list_folders(batches):
        for batch in batches:
            held: list[tuple] = []
            for folder, chain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in _entries(root, folder, chain):
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield _as_batch(held)
                        held = []
            yield _as_batch(held)

    folders = spark.createDataFrame([("", [real_root])], "path string, chain array<string>")
    levels: list[DataFrame] = []
    while not levels or not folders.isEmpty():
        spread = folders.repartition(spark.sparkContext.defaultParallelism)
        levels.append(materialize(spread.mapInArrow(list_folders, _ENTRY_DDL), "listing"))
        folders = levels[-1].where(F.col("kind") == DIRECTORY).select("path", "chain")
    return union_all(*levels).drop("chain")


def _named(listed: DataFrame, root: str) -> DataFrame:
    """Files and unreadable entries as catalog rows; one file under two names has one canonical key."""
    real_root = F.lit(os.path.realpath(root))
    path = F.col("path")
    return listed.where(F.col("kind") != DIRECTORY).select(
        path,
        F.coalesce(paths.display_path(F.col("real"), real_root), paths.canonical_key(path)).alias("canonical_key"),
        paths.file_extension(path).alias("ext"),
        "n_bytes",
        "read_error",
    )


def _spark_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def _relative(path: Column, root: str) -> Column:
    """A listed URI relative to ``root``, whatever file system the root is on."""
    without_host = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return paths.display_path(without_host, F.lit(urlsplit(root).path))


def file_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below ``root``: ``path, canonical_key, ext, n_bytes, read_error``; no content is read.

    Entries that cannot be looked at have a ``read_error`` and no size.  On file systems that are not
    mounted Spark lists instead: in the driver, without names that start with ``.`` or ``_`` and without
    empty files.
    """
    mounted = mounted_path(root)
    if mounted is not None:
        return _named(list_tree(spark, mounted), mounted)
    listed = _spark_files(spark, root).select(_relative(F.col("path"), root).alias("path"), "length")
    path = F.col("path")
    return listed.select(
        path,
        paths.canonical_key(path).alias("canonical_key"),
        paths.file_extension(path).alias("ext"),
        F.col("length").alias("n_bytes"),
        F.lit(None).cast("string").alias("read_error"),
    )


def _read(path: str) -> tuple[str | None, str | None]:
    """(content, read_error) of one file."""
    try:
        with open(path, "rb") as file:
            data = file.read(FILE_BYTES + 1)
        return (data.decode(), None) if len(data) <= FILE_BYTES else (None, TOO_LONG)
    except OSError as fault:
        return None, error_text(fault)
    except UnicodeDecodeError:
        return None, text.NOT_UTF8


def read_contents(listed: DataFrame, root: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """The rows of a file catalog of a mounted root with ``content``, each file opened by one task.

    Files are dealt by the bytes before them, so that a task reads about ``read_bytes``, and more only
    where one file is longer.  A file that is gone, may not be read or is not UTF-8 has a ``read_error``.
    """
    spark = importable_on_workers(listed.sparkSession)
    mounted = mounted_path(root)
    measured = materialize(listed.withColumn("_all", F.lit(1)), "listed")
    size = F.coalesce("n_bytes", F.lit(0))
    dealt = running_totals(measured, ["_all"], [F.col("path")], {"_before": size})
    total = measured.agg(F.sum(size)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // read_bytes))
    dealt = dealt.withColumn("_task", F.expr(f"_before div {read_bytes}")).repartition(tasks, "_task")
    names = ["path", "canonical_key", "ext", "read_error"]

    def read(batches):
        schema = pa.schema([(n, pa.string()) for n in ("path", "canonical_key", "ext", "content", "read_error")])
        for batch in batches:
            held, size = [], 0
            for path, key, ext, fault in zip(*(batch.column(k).to_pylist() for k in range(4))):
                content, error = (None, fault) if fault is not None else _read(f"{mounted}/{path}")
                held.append((path, key, ext, content, error))
                size += len(content or "")
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)

    columns = "path string, canonical_key string, ext string, content string, read_error string"
    return dealt.select(*names).mapInArrow(read, columns)


def file_contents(spark: SparkSession, root: str) -> DataFrame:
    """A catalog of the files below ``root`` with their text.

    What cannot be read, and bytes that are not UTF-8, give a ``read_error`` and no content, not a
    failure.  For the files that are listed see ``file_catalog``.
    """
    if mounted_path(root) is not None:
        return read_contents(file_catalog(spark, root), root)
    read = _spark_files(spark, root).select(
        _relative(F.col("path"), root).alias("path"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
    )
    path = F.col("path")
    return read.select(
        path,
        paths.canonical_key(path).alias("canonical_key"),
        paths.file_extension(path).alias("ext"),
        "content",
        F.when(F.col("content").isNull(), F.lit(text.NOT_UTF8)).alias("read_error"),
    )
