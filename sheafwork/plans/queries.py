"""One query per operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafwork.functions import globs, paths, text as texts
from sheafwork.operators import aliases, bundles, cascade, matching, outlines, reports, selection
from sheafwork.operators.scale import union_all
from sheafwork.plans import testtables as tables
from sheafwork.plans.assembly import assemble
from sheafwork.session import new_location
from sheafwork.sources.files import file_catalog, file_contents
from sheafwork.sources.sinks import write_bundles

ROOT = "/data"
PART_BYTES = 1 << 16
DEPTH = 4
BRACKET_LEVELS = (1, 3, 99)

Query = Callable[[SparkSession, str], DataFrame]


# --- sources and sinks --------------------------------------------------------------------------


def _bundle_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the documents' bundles as files."""
    location = new_location(spark, "bundle-files")
    write_bundles(_document_bundles(spark, sf_dir).parts(PART_BYTES), location, "files")
    return location


def file_catalog_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_catalog(spark, _bundle_files(spark, sf_dir)).where("ext = 'md'")


def file_contents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_contents(spark, _bundle_files(spark, sf_dir)).where("ext = 'md'")


def table_catalog_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(
        tables.document_catalog(spark, sf_dir),
        tables.page_catalog(spark, sf_dir),
        tables.conversation_catalog(spark, sf_dir),
        tables.event_catalog(spark, sf_dir),
    )


def request_batch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.mixed_requests(spark, sf_dir)


def write_bundles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = new_location(spark, "bundles")
    parts = assemble_bundle_query(spark, sf_dir)
    write_bundles(parts, location)
    return spark.read.schema(parts.schema).parquet(location)


# --- scalar functions ---------------------------------------------------------------------------


def display_path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.page_address()
    host = F.substring_index(path, "/", 1)
    return tables.read(spark, sf_dir, "pages").select(
        "page_id",
        paths.display_path(path, host).alias("below_host"),
        paths.display_path(path, F.lit("example")).alias("elsewhere"),
    )


def canonical_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.page_address()
    return tables.read(spark, sf_dir, "pages").select(
        "page_id",
        paths.url_key(path).alias("page_key"),
        paths.canonical_key(F.concat(F.lit("./"), path, F.lit("//x/."))).alias("path_key"),
    )


def file_extension_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = union_all(
        tables.document_catalog(spark, sf_dir, check_unique=False).select("path"),
        tables.page_catalog(spark, sf_dir, check_unique=False).select("path"),
        tables.conversation_catalog(spark, sf_dir, check_unique=False).select("path"),
        tables.event_catalog(spark, sf_dir, check_unique=False).select("path"),
    )
    hidden = F.concat(F.lit("."), F.replace(F.col("path"), F.lit("/"), F.lit("-")))
    return listed.select(
        "path",
        paths.file_extension(F.col("path")).alias("ext"),
        paths.file_extension(hidden).alias("hidden_ext"),
    )


def is_glob_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.mixed_requests(spark, sf_dir).select(
        "request_id", "input_ord", globs.is_glob(F.col("input")).alias("is_glob")
    )


def glob_to_regex_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("input")
    requests = tables.mixed_requests(spark, sf_dir).filter(globs.is_glob(value))
    return requests.select(
        "request_id",
        "input_ord",
        globs.glob_to_regex(value).alias("regex"),
        globs.glob_error(value).alias("error"),
    )


def _line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without, with one and with two newlines at the end, and none of its text."""
    ends = F.explode(F.array(F.lit(""), F.lit("\n"), F.lit("\n\n"))).alias("ending")
    return tables.read(spark, sf_dir, "documents").select("doc_id", "text", ends)


def line_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_endings(spark, sf_dir).select(
        "doc_id",
        F.length("ending").alias("n_ending"),
        texts.line_count(F.concat("text", "ending")).alias("n_lines"),
        texts.line_count(F.col("ending")).alias("n_bare_lines"),
    )


def text_size_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return tables.read(spark, sf_dir, "documents").select(
        "doc_id", texts.char_count(text).alias("n_chars"), texts.byte_count(text).alias("n_bytes")
    )


def trim_end_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("　 "), F.col("text"), F.lit("  \t\x85 \r\n"))
    return tables.read(spark, sf_dir, "documents").select(
        "doc_id", texts.trim_end(padded).alias("trimmed")
    )


def fence_block_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = tables.document_catalog(spark, sf_dir)
    block = texts.fence_block(F.col("path"), F.col("ext"), F.col("content"))
    return catalog.select("path", block.alias("block"))


def content_or_error_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German documents get a byte that UTF-8 does not have, so that their text cannot be read."""
    catalog = tables.damaged_catalog(spark, sf_dir)
    return union_all(
        *[
            bundles.content_or_error(catalog, depth).withColumn("outlined", F.lit(depth is not None))
            for depth in (None, DEPTH)
        ]
    )


# --- matching -----------------------------------------------------------------------------------


def _matching(operator) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = matching.distinct_inputs(tables.mixed_requests(spark, sf_dir))
        return operator(inputs, tables.document_catalog(spark, sf_dir))

    return query


def _mixed(spark: SparkSession, sf_dir: str) -> cascade.Resolution:
    requests = tables.mixed_requests(spark, sf_dir)
    return cascade.resolve(requests, tables.document_catalog(spark, sf_dir), ROOT)


def resolve_cascade_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).matches()


def attach_content_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = tables.document_catalog(spark, sf_dir)
    resolution = cascade.resolve(tables.directory_requests(spark, sf_dir), catalog)
    contents = catalog.select("path", "content")
    return selection.attach_content(selection.chosen_files(resolution), contents)


def unmatched_inputs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolution = _mixed(spark, sf_dir)
    found = resolution.outcomes.filter("n_matches > 0")
    return matching.unmatched_inputs(resolution.requests, found)


# --- outcomes -----------------------------------------------------------------------------------


def resolution_status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.resolution_status(_mixed(spark, sf_dir))


def request_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.request_gate(resolution_status_query(spark, sf_dir))


def outcome_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.outcome_counts(resolution_status_query(spark, sf_dir))


def keep_first_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.page_requests(spark, sf_dir)
    resolution = cascade.resolve(requests, tables.page_catalog(spark, sf_dir))
    return selection.keep_first(resolution.matches())


def ordered_candidates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ordered_candidates(_mixed(spark, sf_dir).matches())


def conflict_preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conflict_preview(_mixed(spark, sf_dir))


def error_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_report(_mixed(spark, sf_dir))


# --- bundles ------------------------------------------------------------------------------------


def _document_bundles(spark: SparkSession, sf_dir: str):
    requests = tables.directory_requests(spark, sf_dir)
    return assemble(requests, tables.document_catalog(spark, sf_dir))


def _page_outlines(spark: SparkSession, sf_dir: str):
    requests = tables.page_requests(spark, sf_dir)
    return assemble(requests, tables.page_catalog(spark, sf_dir), max_depth=DEPTH)


def assemble_bundle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_bundles(spark, sf_dir).parts(PART_BYTES)


def conversation_bundles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.conversation_requests(spark, sf_dir)
    return assemble(requests, tables.conversation_catalog(spark, sf_dir)).parts(PART_BYTES)


def outline_bundles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_outlines(spark, sf_dir).parts(PART_BYTES)


def bundle_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_bundles(spark, sf_dir).totals()


def outline_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_outlines(spark, sf_dir).totals()


def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_bundles(spark, sf_dir).manifest()


def outline_manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_outlines(spark, sf_dir).manifest()


# --- outlines -----------------------------------------------------------------------------------


def nesting_depth_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.read(spark, sf_dir, "pages")
    tokens = outlines.tokenize(pages, "page_id", "html", F.lit(outlines.MARKUP))
    return outlines.nesting_depth(tokens).drop("kind")


def join_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At this depth the pages have no text of their own but a footer, and some not even that."""
    pages = tables.read(spark, sf_dir, "pages")
    tokens = outlines.tokenize(pages, "page_id", "html", F.lit(outlines.MARKUP))
    return outlines.join_tokens(tokens, 2)


def outline_markup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.outline_markup(tables.read(spark, sf_dir, "pages"), "page_id", "html", DEPTH)


def outline_brackets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested JSON, with their properties at level 4, cut at several levels."""
    nested = F.concat(
        F.lit('{"at":[{"id":'), "event_id", F.lit(',"props":'), "props",
        F.lit('}],"type":"'), "event_type", F.lit('"}'),
    )
    events = tables.read(spark, sf_dir, "events").select("event_id", nested.alias("nested"))
    return outlines.outline_levels(events, "event_id", "nested", BRACKET_LEVELS)


def resolve_aliases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.resolve_aliases(tables.turn_aliases(spark, sf_dir))


def outline_indent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlines.outline_indent(tables.script_catalog(spark, sf_dir), "path", "content", 1)


def outline_dispatch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = union_all(
        tables.document_catalog(spark, sf_dir),
        tables.page_catalog(spark, sf_dir),
        tables.event_catalog(spark, sf_dir),
        tables.script_catalog(spark, sf_dir),
    )
    return outlines.outline_dispatch(catalog, 1)


QUERIES: dict[str, Query] = {
    "file_catalog": file_catalog_query,
    "file_contents": file_contents_query,
    "table_catalog": table_catalog_query,
    "request_batch": request_batch_query,
    "write_bundles": write_bundles_query,
    "display_path": display_path_query,
    "canonical_key": canonical_key_query,
    "resolve_aliases": resolve_aliases_query,
    "file_extension": file_extension_query,
    "is_glob": is_glob_query,
    "glob_to_regex": glob_to_regex_query,
    "line_count": line_count_query,
    "text_size": text_size_query,
    "trim_end": trim_end_query,
    "fence_block": fence_block_query,
    "content_or_error": content_or_error_query,
    "match_direct": _matching(matching.match_direct),
    "match_directory": _matching(matching.match_directory),
    "match_glob": _matching(matching.match_glob),
    "match_substring": _matching(matching.match_substring),
    "resolve_cascade": resolve_cascade_query,
    "attach_content": attach_content_query,
    "unmatched_inputs": unmatched_inputs_query,
    "resolution_status": resolution_status_query,
    "request_gate": request_gate_query,
    "outcome_counts": outcome_counts_query,
    "bundle_totals": bundle_totals_query,
    "outline_totals": outline_totals_query,
    "assemble_bundle": assemble_bundle_query,
    "conversation_bundles": conversation_bundles_query,
    "outline_bundles": outline_bundles_query,
    "join_tokens": join_tokens_query,
    "keep_first": keep_first_query,
    "manifest": manifest_query,
    "outline_manifest": outline_manifest_query,
    "conflict_preview": conflict_preview_query,
    "nesting_depth": nesting_depth_query,
    "ordered_candidates": ordered_candidates_query,
    "error_report": error_report_query,
    "outline_markup": outline_markup_query,
    "outline_brackets": outline_brackets_query,
    "outline_indent": outline_indent_query,
    "outline_dispatch": outline_dispatch_query,
}
