"""The registered queries of the corpus operators: each applies its operator, with production parameters, to its
whole table. ``QUERIES`` maps names to functions of (spark, sf_dir), ``ORACLES`` names to DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.centroids import cluster_vectors
from weftline.llm.common import new_path, table
from weftline.llm.decontamination import find_leaks
from weftline.llm.filter_audit import audit_filters
from weftline.llm.html_extraction import extract_main_text
from weftline.llm.language_id import identify, learn_languages
from weftline.llm.license_scan import scan_licenses
from weftline.llm.mixing import mix
from weftline.llm.near_duplicates import near_duplicates
from weftline.llm.oracles import ORACLES  # noqa: F401  part of what is registered
from weftline.llm.packing import pack
from weftline.llm.quality_rules import judge
from weftline.llm.token_counts import token_counts
from weftline.llm.token_files import document_digests, read_token_files, write_token_files
from weftline.llm.toxicity import learn_stems, score_toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the number of windows that met depends on the hash functions, so it is no part of the result
    return scan_licenses(table(spark, sf_dir, "documents")).drop("n_windows")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn_stems(docs, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_languages(docs))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return document_digests(read_token_files(spark, path))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
    "op11_filter_audit": op11_filter_audit,
    "op12_mixing": op12_mixing,
    "op13_centroid_clustering": op13_centroid_clustering,
}

