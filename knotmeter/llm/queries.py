"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotmeter.llm import (
    exact_search, filter_audit, fingerprints, html_text, mixing, near_dups, packing, pii, quality, sharding, substrings, training_order,
    vector_codes,
)
from knotmeter.llm.common import row_key, table
from knotmeter.llm.oracle import ORACLES
from knotmeter.session import materialize

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 24


def _of_kind(kind: int) -> Callable:
    return lambda span: span["kind"] == kind


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    joined = substrings.words_joined(F.col("text"))
    cut = substrings.cut_documents(docs, width=35).select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    whole = docs.select(*row_key(), "doc_id", joined.alias("joined"))
    whole = whole.select("k1", "k2", "doc_id", substrings.word_count(F.col("joined")).alias("n_words"), F.sha2("joined", 256).alias("whole_sha256"))
    return whole.join(cut, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.base64("fingerprint").alias("fingerprint"),
        F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tree = sharding.regular_tree(SHARDS)
    out = sharding.sharded_documents(docs, tree, sharding.grown_tree(tree))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(pii.BASE_KINDS))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are measured once, for the forest and for the verdicts
    stats = materialize(quality.statistics(table(spark, sf_dir, "documents")))
    found = quality.judged_statistics(stats, quality.fit_statistics(stats, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_remove_repeats, op3_near_duplicates, op4_fingerprints, op5_shard_documents,
        op6_main_text, op7_personal_data, op8_training_order, op9_quality, op10_pack_documents, op11_vector_codes,
        op12_exact_search, op13_filter_audit,
    )
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py``, which stands at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
