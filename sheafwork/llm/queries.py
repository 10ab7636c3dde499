"""One registered query per operator of this package, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheafwork.llm import (
    attribution, decontaminate, imatch, language, manifest, minhash, packing, pii, quality, repeats, simhash,
    whitening, wrappers,
)
from sheafwork.llm.oracles import ORACLES as ORACLES
from sheafwork.llm.tables import importable_on_workers, read, shared


def _remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where("quality in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("label"))
    measured = shared(quality.document_statistics(docs, ["doc_id", "text"]), "statistics")
    labelled = measured.where(_remainder(4) != 2).join(labels, "doc_id")
    model = quality.fit_discriminant(labelled)
    scored = quality.score_quality(measured, model)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(read(spark, sf_dir, "documents"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )
    return found.drop("items", "spans")


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(read(spark, sf_dir, "pages"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs.where(_remainder(5) != 0))
    found = language.predict_language(docs, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(read(spark, sf_dir, "documents")).drop("kept", "removed")


def section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(read(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda span: span["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{kind}")
        for k, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.spans_as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.spans_as_text(F.col("spans")).alias("spans"),
    )


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    without_lines = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return manifest.verify_documents(read(spark, sf_dir, "documents"), _remainder(2) == 0, without_lines)


def signature_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(read(spark, sf_dir, "embeddings"))


def _registered(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(importable_on_workers(spark), sf_dir)

    return run


QUERIES = {
    name: _registered(query)
    for name, query in {
        "op1_quality_discriminant": quality_scores,
        "op2_imatch_fingerprints": fingerprints,
        "op3_wu_manber_contamination": contamination,
        "op4_wrapper_texts": main_texts,
        "op5_ppm_language": languages,
        "op6_simhash_popcount": near_duplicates,
        "op7_prefix_free_repeats": repeated_strings,
        "op8_token_attribution": section_tokens,
        "op9_bootstrapped_pii": personal_data,
        "op10_certified_packing": packed_sequences,
        "op11_midstate_manifest": merkle_manifest,
        "op12_signature_join": signature_duplicates,
        "op13_incremental_whitening": whitened_embeddings,
    }.items()
}
