"""Catalogs and request batches over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheafwork.functions import paths
from sheafwork.functions.text import NOT_UTF8
from sheafwork.sources.tables import request_batch, table_catalog


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt"))


def page_address() -> Column:
    return paths.url_path(F.col("url"))


def page_path() -> Column:
    """A URL may have been fetched more than once, so a page is a file in its URL's folder."""
    folder = F.rtrim(page_address(), F.lit("/"))
    return F.concat(folder, F.lit("/"), "page_id", F.lit(".html"))


def document_catalog(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return table_catalog(read(spark, sf_dir, "documents"), document_path(), "text", **options)


def damaged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as bytes, the German ones with one that is not UTF-8, read as text again."""
    damage = F.when(F.col("lang") == "de", F.lit(b"\xff")).otherwise(F.lit(b""))
    data = F.concat(F.col("text").cast("binary"), damage)
    documents = read(spark, sf_dir, "documents").withColumn(
        "text", F.try_validate_utf8(data.cast("string"))
    )
    unreadable = F.when(F.col("text").isNull(), F.lit(NOT_UTF8))
    return table_catalog(documents, document_path(), "text", read_error=unreadable)


def page_catalog(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return table_catalog(
        read(spark, sf_dir, "pages"),
        page_path(),
        "html",
        canonical_key=paths.url_key(page_address()),
        **options,
    )


def conversation_catalog(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    turn = F.format_string("%03d", F.col("turn"))
    path = F.concat("conv_id", F.lit("/"), turn, F.lit("-"), "role", F.lit(".md"))
    return table_catalog(read(spark, sf_dir, "conversations"), path, "text", **options)


def event_catalog(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    path = F.concat("event_type", F.lit("/"), "event_id", F.lit(".json"))
    return table_catalog(read(spark, sf_dir, "events"), path, "props", **options)


def script_catalog(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Each document as a function: its first line one level in, the others two."""
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".py"))
    body = F.replace("text", F.lit("\n"), F.lit("\n        "))
    content = F.concat(F.lit("def doc_"), "doc_id", F.lit("():\n    "), body)
    return table_catalog(read(spark, sf_dir, "documents"), path, content, **options)


def directory_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per source and language: that directory first, then the whole source."""
    groups = (
        read(spark, sf_dir, "documents")
        .groupBy("source", "lang")
        .agg(F.min("doc_id").alias("request_id"))
    )
    return request_batch(
        groups, "request_id", F.array(F.concat_ws("/", "source", "lang"), F.col("source"))
    )


def mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with inputs of every tier and, but for English documents, of every fault.

    One request per document, whose inputs select few paths each, and one per source and language,
    with a negative id, which asks for that directory.  So the matches grow with the documents.  And one
    per document, with an id below -10^9, that has no inputs, a NULL for its inputs, or one among them.
    """
    doc_id = F.col("doc_id").cast("string")
    source, path, lang = F.col("source"), document_path(), F.col("lang")

    def text(*pieces) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    english = F.array(
        path,
        text("./", path),
        text(source, "/*/", doc_id, ".t?t"),
        text("*/en/", doc_id, "*.txt"),
        text(source, "/[!d]?/", doc_id, ".txt"),
        text("en/", doc_id, ".t"),
    )
    french = F.array(
        text("./", path),
        text("**/", doc_id, ".txt"),
        text("fr/", doc_id, "."),
        text("zzz", doc_id),
    )
    german = F.array(path, text("/", doc_id), text("no/such/", doc_id))
    other = F.array(
        path,
        text(source, "/[", doc_id),
        text("{", source, ",x}/", doc_id),
        text(doc_id, ".txt"),
        path,
    )
    inputs = (
        F.when(lang == "en", english)
        .when(lang == "fr", french)
        .when(lang == "de", german)
        .otherwise(other)
    )
    documents = read(spark, sf_dir, "documents")
    directory = F.concat_ws("/", "source", "lang")
    asked = F.array(directory, text("./", directory, "/"))
    directories = documents.groupBy("source", "lang").agg(F.min("doc_id").alias("least")).select(
        (-1 - F.col("least")).alias("doc_id"),
        F.when(lang == "en", asked)
        .otherwise(F.concat(asked, F.array(text("zzz", directory))))
        .alias("inputs"),
    )
    none = F.lit(None).cast("string")
    faulty = documents.select(
        (F.lit(-1_000_000_000) - F.col("doc_id")).alias("doc_id"),
        F.when(lang == "en", F.array().cast("array<string>"))
        .when(lang == "de", F.array(path, none))
        .when(lang != "fr", F.array(path))
        .alias("inputs"),
    )
    asked = documents.select("doc_id", inputs.alias("inputs"))
    return request_batch(asked.unionByName(directories).unionByName(faulty), "doc_id", "inputs")


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per language directory of the sites: its pages first, then all pages."""
    lang = F.split(page_address(), "/").getItem(1)
    groups = (
        read(spark, sf_dir, "pages")
        .groupBy(lang.alias("lang"))
        .agg(F.min("page_id").alias("request_id"))
    )
    inputs = F.array(F.concat(F.lit("*/"), "lang", F.lit("/*/*")), F.lit(""))
    return request_batch(groups, "request_id", inputs)


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per conversation: all its turns."""
    groups = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return request_batch(groups, "conv_id", F.array(F.col("conv_id").cast("string")))


def turn_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation stands for the one before; in every fifth, the first for the second."""

    def name(turn: Column) -> Column:
        return F.concat("conv_id", F.lit("/"), turn)

    turn = F.col("turn")
    first = F.when(F.col("conv_id") % 5 == 0, name(F.lit(1)))
    turns = read(spark, sf_dir, "conversations")
    return turns.select(
        name(turn).alias("alias"), F.when(turn > 0, name(turn - 1)).otherwise(first).alias("target")
    ).where("target is not null")
