"""Render the chosen files as Markdown blocks, measure them and put them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheafwork.functions import paths, text as texts
from sheafwork.operators.outlines import outline_dispatch
from sheafwork.operators.scale import dealt_by_bytes, fits_broadcast, possibly_in, running_totals
from sheafwork.operators.selection import attach_content
from sheafwork.session import materialize, measured, with_size

#: A part of a bundle is closed by the block that reaches this size.
PART_BYTES = 32 << 20

#: Parts of so many bytes, or one part if it is larger, are made together in one task, about.
TASK_BYTES = 16 << 20


def content_or_error(catalog: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``path, hint, body``: the text that stands for each file in a bundle.

    That is its content, or its outline if a depth is given, or the error met on reading it.
    The hint is the extension, and empty for outlines.
    """
    failed = F.col("read_error").isNotNull()
    error = texts.read_error_text(F.col("path"), F.col("read_error"))
    if max_depth is None:
        body = F.when(failed, error).otherwise(F.coalesce("content", F.lit("")))
        return catalog.select("path", F.col("ext").alias("hint"), body.alias("body"))
    errors = catalog.filter(failed).select("path", error.alias("body"))
    readable = catalog.filter(~failed).withColumn("content", F.coalesce("content", F.lit("")))
    bodies = outline_dispatch(readable, max_depth).unionByName(errors)
    return bodies.select("path", F.lit("").alias("hint"), "body")


def file_blocks(bodies: DataFrame) -> DataFrame:
    """``path, block``: the Markdown of each file."""
    return bodies.select(
        "path", texts.fence_block(F.col("path"), F.col("hint"), F.col("body")).alias("block")
    )


def measure(bodies: DataFrame) -> DataFrame:
    """Sizes of each file's text and block; no text goes further than this."""
    body = F.col("body")
    block = texts.fence_block(F.col("path"), F.col("hint"), body)
    return bodies.select(
        "path",
        texts.line_count(body).alias("n_lines"),
        texts.char_count(body).alias("n_chars"),
        texts.byte_count(body).alias("n_bytes"),
        texts.byte_count(block).alias("block_bytes"),
    )


def only_chosen(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """The catalog's rows for paths that some request chose, found without a shuffle of content.

    Where the chosen paths do not measure small they go into a filter by hash, which lets few others
    pass; those are dropped by the join that attaches the content.
    """
    chosen = files.select("path").distinct()
    if not fits_broadcast(chosen, bound=files):
        return possibly_in(catalog, chosen, "path")
    return catalog.join(F.broadcast(chosen), ["path"], "left_semi")


def number_files(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """Chosen files with their sizes, their place in the bundle and the bytes before them.

    The sizes are written first: to cut rows into ranges Spark samples them, and that must not
    read the texts again.
    """
    sized = materialize(attach_content(files, sizes), "sized-files")
    order = [F.col("input_ord"), paths.path_order(F.col("path"))]
    totals = {"before": F.lit(1), "start_byte": F.col("block_bytes")}
    placed = running_totals(sized, ["request_id"], order, totals)
    numbered = placed.withColumn("seq", (F.col("before") + 1).cast("bigint")).drop("before")
    return with_size(numbered, measured(placed))


def manifest(numbered: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Numbered list of the files in each bundle, with lines, or characters for outlines."""
    label, metric, unit = F.col("path"), F.col("n_lines"), "lines"
    if max_depth is not None:
        # Fixed value: the label of an outline.
        label = F.format_string("%s (skeleton only; depth=%d)", label, F.lit(max_depth))
        metric, unit = F.col("n_chars"), "characters"
    return numbered.select(
        "request_id", "seq", label.alias("label"), metric.alias("metric"), F.lit(unit).alias("unit")
    )


def bundle_totals(sized: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files per bundle and its total: lines of the texts, or for outlines bytes of the Markdown.

    The latter go by the name of characters.
    """
    metric, unit = ("n_lines", "lines") if max_depth is None else ("block_bytes", "characters")
    totals = sized.groupBy("request_id").agg(
        F.count("*").alias("n_files"), F.sum(metric).alias("total_metric")
    )
    return totals.select("*", F.lit(unit).alias("unit"), _summary(F.lit(unit)).alias("summary"))


def _summary(unit: Column) -> Column:
    files = F.when(F.col("n_files") == 1, F.lit("file")).otherwise(F.lit("files"))
    return F.format_string("%d %s, %d %s", "n_files", files, "total_metric", unit)


def assemble_bundle(
    numbered: DataFrame, blocks: DataFrame, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``request_id, part_no, n_files, markdown``: the blocks of each request, in order.

    A bundle may be larger than a task can hold, so it is cut between blocks into parts of about
    ``part_bytes``; the parts one after the other are the bundle.  Parts are dealt to tasks in the order
    of their first paths, so that parts of several requests with the same files are made in one task:
    a block is sent there once, with the list of its places, and not once per request.
    """
    part_no = F.expr(f"CAST(start_byte DIV {int(part_bytes)} AS BIGINT)")
    part = ["request_id", "part_no"]
    placed = numbered.withColumn("part_no", part_no)
    sizes = placed.groupBy(*part).agg(
        F.min_by("path", "seq").alias("first"), F.sum("block_bytes").alias("size")
    )
    task_bytes = max(TASK_BYTES, int(part_bytes))
    tasks, n_tasks = dealt_by_bytes(sizes, [F.col("first"), *map(F.col, part)], "size", task_bytes)
    places = F.collect_list(F.struct(*part, "seq")).alias("places")
    sent = (
        placed.select(*part, "seq", "path")
        .join(tasks.select(*part, "task"), part)
        .groupBy("task", "path")
        .agg(places)
    )
    sent = materialize(sent, "sent-blocks")
    markdown = F.expr("listagg(block, '') WITHIN GROUP (ORDER BY place.seq)")
    return (
        attach_content(sent, blocks)
        .repartition(n_tasks, "task")
        .select("task", "block", F.explode("places").alias("place"))
        .groupBy("task", F.col("place.request_id").alias("request_id"), F.col("place.part_no").alias("part_no"))
        .agg(F.count("*").alias("n_files"), markdown.alias("markdown"))
        .drop("task")
    )
