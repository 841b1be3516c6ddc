"""From raw documents to training shards: five operators in a row, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronark.llm import _runtime, decontaminate, jaccard, language_id, mixing, sharding


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification accepts; ``lang`` becomes the language it finds.

    The models learn from all documents with a language. Texts without a letter, and those far worse than their language's
    own texts, go. Rows with an id that repeats keep the language of each row's own text.
    """
    model = language_id.train(docs)
    return language_id.keep_accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that the n-gram Jaccard join finds: the one with the smallest id.

    Texts without words, null ones too, are in no class and stay, as do rows without an id; of rows that repeat the kept id all
    stay. An empty table gives an empty one.
    """
    return jaccard.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item of ``benchmark``.

    Null and empty texts hold none and stay; rows without an id and repeated rows are judged each by its text. Items without an
    id, a text or a word aren't searched. An empty table of either kind drops nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, in the order of the mix; those it doesn't take go.

    Texts without words, null ones too, cost nothing and stay once. Null is a source like others. Rows that repeat an id, text
    and source share what the mix takes of them. An empty table gives an empty one.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mix.

    Null texts count as empty; equal texts, so also the copies of a row, share a shard. Rows without an id and repeated rows
    each get a slot. An empty table gives an empty one.
    """
    return sharding.assign(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Language models and edit distances to a part of a text are beyond SQL: tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{_runtime.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
