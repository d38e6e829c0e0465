"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtraffic.llm import (
    host_paths,
    legacy_archive,
    license_scan,
    lsh_forest,
    mixing,
    packing,
    pivot_annuli,
    suffix_repeats,
    token_alignment,
    token_counts,
    toxicity,
    vantage_trees,
    vector_codes,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


def op2_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_trees.nearest(table(spark, sf_dir, "embeddings"))


def op3_pivot_annuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_annuli.top_scores(table(spark, sf_dir, "embeddings"))


def op4_legacy_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy_archive.archived(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


def op7_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.main_text(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_id", "n_links", "n_text_links")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digests(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_vantage_trees": op2_vantage_trees,
    "op3_pivot_annuli": op3_pivot_annuli,
    "op4_legacy_archive": op4_legacy_archive,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_host_paths": op7_host_paths,
    "op8_license_scan": op8_license_scan,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_suffix_repeats": op10_suffix_repeats,
    "op11_token_counts": op11_token_counts,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op3_pivot_annuli": pivot_annuli.top_scores_sql(),
    "op8_license_scan": license_scan.scan_sql(),
    "op13_vector_codes": vector_codes.code_report_sql(),
}
