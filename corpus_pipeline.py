"""A corpus pipeline: what each stage keeps is written out and is the next stage's input.

toxicity: documents that score THRESHOLD or more go. exact: of equal texts the smallest doc_id stays. near: of each group
of texts whose sets of five-word shingles are similar by 0.8 or more, as their SimHash fingerprints tell, the smallest
doc_id stays. benchmark: documents with a window of a benchmark item go. mix: documents that the mix takes, with size,
source_size, target and taken.

Stages judge rows, not identifiers: repeated and null identifiers are rows like others, null being the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshframe.llm import decontaminate, exact_dedup, mixing, simhash_dedup, toxicity
from meshframe.llm.common import forget_rows, removed, table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one_a_group(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact", remove_copies),
    ("near", remove_near_copies),
    ("benchmark", remove_benchmark),
    ("mix", mix),
]

#: Toxicity is learned, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; of the tables between, the one before is deleted when the next is complete."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget_rows(spark)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
