"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents: language ID drops texts without a letter, exact dedup keeps one row of each group, near-dedup
one row of each component, mixing repeats or drops rows as its targets ask, and BPE returns what op4 returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import bpe, exact_dedup, language, mix, simhash
from siftwork.llm.common import documents
from siftwork.session import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_near(docs, shingle_words=4, max_distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Suffix automata, SimHash and BPE have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    home = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    df = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, df, sf_dir).write.parquet(f"{home}/{name}")
        df = spark.read.parquet(f"{home}/{name}")
    return df
