"""The corpus pipeline: language ID, quality, near duplicates, benchmark passages, packing.

Each stage takes what its predecessor kept, read back from Parquet; all but the
last return the columns of ``documents``. A stage with an empty input returns an
empty result; the rules for nulls, ties and repeated rows are its operator's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import decontaminate, lang_id, near_dup, packing, quality
from pitchside.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or with no language for half of their words, go."""
    return lang_id.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from their labels, scores 0.7 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return near_dup.keep_one_each(docs, k=5, num=80, den=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, also with other numbers, names or units."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, neighbours along the Hilbert curve together."""
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "hkey")


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The learned stages and the tokenizer cannot be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
