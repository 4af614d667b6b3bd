"""The corpus pipeline: language ID, toxicity, near duplicates, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return rows of
``documents`` with their columns. Between stages the rows are written as Parquet into the shared folder and read again,
and a stage begins with the heaps of the executors collected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table
from weftline.llm.decontamination import drop_leaks
from weftline.llm.language_id import keep_identified, learn_languages
from weftline.llm.near_duplicates import drop_duplicates
from weftline.llm.packing import pack
from weftline.llm.toxicity import drop_toxic, learn_stems
from weftline.session import collect_garbage, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language is in doubt."""
    collect_garbage(spark)
    return keep_identified(docs, learn_languages(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the grammar, with stems learned from the labels of what is left, takes for toxic."""
    collect_garbage(spark)
    return drop_toxic(docs, learn_stems(docs, table(spark, sf_dir, "labels")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near duplicates."""
    collect_garbage(spark)
    return drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to the error budget."""
    collect_garbage(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of at most 1024 tokens."""
    collect_garbage(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Compression, learned stems and tokenizers are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
