"""From documents to a training mix: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairfield.llm import decontaminate, mixing, pii, quality, simhash, similar
from pairfield.llm.common import removed, shared_dir, table, temporary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprints or by shingles of five words, stays."""
    return simhash.one_of_each(docs, found=similar.near_duplicates(docs))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates."""
    return pii.surrogates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks."""
    return mixing.repeated(mixing.mix(docs))


STAGES = [("quality classifier", good), ("simhash near-dedup", distinct), ("benchmark decontamination", unseen), ("pii surrogates", private), ("mixing", mixed)]

#: SQL expresses neither the trained classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages write on the way is deleted, each stage's output as soon as the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), []
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        removed(spark, before)
        before = [f"{base}/{i}"]
        docs = spark.read.parquet(*before)
    return docs
