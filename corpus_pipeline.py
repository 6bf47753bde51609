"""Corpus pipeline: language, near duplicates, contamination, surrogates, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and read again as the documents of the next one.
The first four return the columns of their input, rows in fewer number or with
another text; the last returns digests of the token ids.

Rows are told apart by id and text where a stage needs to find them again: rows
with equal id and text stay or go together. NULL ids pass. An empty table stays
empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm import bpe, decontaminate, language, neardup, pii
from segspark.runtime import materialize

SURROGATE_KEY = "corpus-pipeline"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without any letter go.

    The model learns from the `lang` column of the documents at hand.
    """
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    kept = neardup.near_duplicates(docs)
    return _without(docs, kept.filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in 20 lie in benchmark windows."""
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, judged.filter("contaminated"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return pii.replace_entities(docs, SURROGATE_KEY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of all documents."""
    return bpe.round_trip_digests(docs, VOCABULARY, public_tokenizers.PATTERN)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows that are not among those to go."""
    key = F.xxhash64("doc_id", "text")
    return (docs.withColumn("__row", key).join(gone.select(F.col("row_key").alias("__row")).distinct(), "__row", "left_anti")
            .select(*docs.columns))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("surrogates", replace_personal_data),
    ("tokens", encode),
]

#: Language scores, components and token ids are not expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
