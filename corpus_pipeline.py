"""The corpus pipeline: documents through language ID, exact dedup, near dedup, mixing and tokenisation.

Defined results. Texts that are null, empty or without a letter go in the first stage. Rows keep all their
columns, whatever these are called; rows that repeat one another wholly are copies, of which one stays. A
null doc_id is an id like others: of near copies the smallest id stays, null last. Long texts are read
whole. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from wordloom.llm.common import fold, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; learns from the labelled rows that the query learns from."""
    model = language_id.train(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    return language_id.recognised(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays."""
    return exact_dedup.distinct_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of tokens."""
    return mixing.sampled(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text and, decoding them, whether they give the text back."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encoded(docs, path, pattern, back=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokenise", tokenise)]

#: Classifiers, components and raking are beyond SQL; tests/llm/test_pipeline.py compares each stage with brute
#: force, or with its operator where that is a classifier or a draw.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
