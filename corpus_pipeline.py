"""The training-data pipeline: five stages over the documents, each written as Parquet and read as the next one's input.

A stage takes (spark, docs, folder of tables) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, mixing, near_texts, quality, surrogates
from corpusloom.sources.tables import checkpoint_dir, discard, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_texts.near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; n_chars follows the new text."""
    return surrogates.rewritten(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with what it takes of each: size, source_size, target, taken, epochs. What it does not take is left out."""
    return mixing.mixed(docs).where("taken > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("source mix", source_mix),
]

#: Fingerprints, tilings and surrogates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. Stage results go to the shared folder of spark.checkpoint.dir.

    When a stage is written, its checkpoints and the result of the stage before go: two results are kept at a time,
    and the last one stays.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        if number:
            discard(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
