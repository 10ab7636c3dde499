"""Sinks for assembled bundles."""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.session import importable_on_workers, materialize
from sheafwork.sources.files import FILE, list_tree, mounted_path, read_contents

FORMATS = ("parquet", "json", "text", "files")
#: The table of the parts that belong to a folder of files.
MANIFEST = "_manifest"


def write_bundles(parts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write bundle parts, each file in order by request and part.

    ``parquet`` and ``json`` hold one row per part.  ``text`` holds the Markdown itself, one folder
    per request whose files, in name order, make up the bundle.  ``files`` is a folder per request
    with one file per part on a mounted file system, see ``write_files``.  Parts know their request and
    number, so they are written by the tasks that make them.  Only ``text``, where the order of the files
    tells that of the parts, spreads them by range; there they are written once before, so that to find
    the ranges does not assemble the bundles a second time.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {', '.join(FORMATS)}")
    order = ["request_id", "part_no"]
    if fmt == "text":
        placed = materialize(parts, "parts").repartitionByRange(*order).sortWithinPartitions(*order)
        # A part ends with a blank line; the writer adds the last of the two newlines.
        body = F.col("markdown").substr(F.lit(1), F.length("markdown") - 1)
        placed.select("request_id", body.alias("value")).write.partitionBy("request_id").text(path)
    elif fmt == "files":
        write_files(parts, path)
    else:
        writer = parts.sortWithinPartitions(*order).write
        if fmt == "parquet":
            writer = writer.option("compression", "zstd")
        writer.format(fmt).save(path)


def part_name(request_id: int, part_no: int) -> str:
    return f"{request_id}/{part_no:08d}.md"


def _write_part(root: str, name: str, data: bytes) -> None:
    """Put a whole file in its place at once; what is left of a killed task is never under a part's name."""
    folder = os.path.dirname(f"{root}/{name}")
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{uuid.uuid4().hex}.draft"
    with open(draft, "wb") as file:
        file.write(data)
        file.flush()
        os.fsync(file.fileno())
    os.replace(draft, f"{root}/{name}")


def write_files(parts: DataFrame, path: str) -> DataFrame:
    """One file per part, ``<request_id>/<part_no>.md``, and the manifest of the files; returns that.

    Every part is written under a name of its own and then moved to its place, so a task that is run
    again, or twice at a time, writes the same file.  The manifest (request_id, part_no, path, n_bytes,
    sha256) is a Parquet table that Spark commits as a whole after all tasks ended: a folder without it, or
    with one that was not committed, holds no bundle, and files that it does not name, left by an earlier run that failed, are
    removed.  A folder with a manifest is not written again.
    """
    spark = importable_on_workers(parts.sparkSession)
    root = mounted_path(path)
    if root is None:
        raise ValueError(f"{path!r} is not on a mounted file system")
    if os.path.exists(f"{root}/{MANIFEST}/_SUCCESS"):
        raise FileExistsError(f"{root} holds bundles already")

    def write(batches):
        for batch in batches:
            rows = []
            for request_id, part_no, markdown in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = (markdown or "").encode()
                name = part_name(request_id, part_no)
                _write_part(root, name, data)
                rows.append((request_id, part_no, name, len(data), hashlib.sha256(data).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            columns = list(zip(*rows)) or [[]] * len(kinds)
            names = ["request_id", "part_no", "path", "n_bytes", "sha256"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    ids = [F.col(c).cast("bigint").alias(c) for c in ("request_id", "part_no")]
    schema = "request_id bigint, part_no bigint, path string, n_bytes bigint, sha256 string"
    parts.select(*ids, "markdown").mapInArrow(write, schema).write.mode("overwrite").parquet(f"file://{root}/{MANIFEST}")
    manifest = files_manifest(spark, path)
    _remove_strays(manifest, root)
    return manifest


def files_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, part_no, path, n_bytes, sha256`` of the parts in a folder of files."""
    return spark.read.parquet(f"file://{mounted_path(path)}/{MANIFEST}")


def _remove_strays(manifest: DataFrame, root: str) -> None:
    """Delete the parts and drafts below ``root`` that no row of the manifest names."""
    listed = list_tree(manifest.sparkSession, root)
    written = F.col("path").rlike(r"^-?\d+/(\d{8,}[.]md|[.][0-9a-f]{32}[.]draft)$")
    strays = listed.where((F.col("kind") == FILE) & written).join(manifest, "path", "left_anti").select("path")

    def remove(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    os.remove(f"{root}/{name}")
                except FileNotFoundError:
                    pass
            yield batch

    strays.mapInArrow(remove, "path string").write.format("noop").mode("overwrite").save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``request_id, part_no, markdown, read_error`` of a folder of files, by its manifest.

    A part that is gone, cannot be read or has other bytes than were written has a ``read_error``.
    """
    manifest = files_manifest(spark, path)
    listed = manifest.select(
        "path", F.col("path").alias("canonical_key"), F.lit("md").alias("ext"), "n_bytes",
        F.lit(None).cast("string").alias("read_error"),
    )
    read = read_contents(listed, path).select("path", "content", "read_error")
    same = F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256")
    return manifest.join(read, "path").select(
        "request_id", "part_no", F.when(same, F.col("content")).alias("markdown"),
        F.coalesce("read_error", F.when(~same, F.lit("bytes differ from the manifest"))).alias("read_error"),
    )
