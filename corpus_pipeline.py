"""Corpus preparation: five stages over the documents table, each one of the corpus operators.

Every stage works on all rows its predecessor kept and returns the columns of
documents, the last one token ids besides. Stages pass Parquet files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemograph.llm import byte_bpe, decontaminate, language_id, near_dedup, quality_rules
from mnemograph.llm.common import stored, table

#: Scores below this are no language. With k languages the best is 1/k at least, so up to five the floor of coverage decides.
LEAST_SCORE = 0.2
#: Text parts that the encoder's cache remembers: fewer than by default, as all workers that served other stages before may hold one.
CACHE_PARTS = 50_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts in which no language is recognised. Learned from the labelled languages not held out."""
    return language_id.accepted(docs, language_id.fit(docs, ~language_id.held_out()), LEAST_SCORE)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that the base rules or the learned decision list reject."""
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each class of near copies."""
    return near_dedup.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts of which a twentieth or more is benchmark windows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the byte-level BPE ids of their texts in column ids."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), cache=CACHE_PARTS)[0]


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("byte_level_bpe", encode_tokens),
]

#: Language, quality and near copies can't be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
