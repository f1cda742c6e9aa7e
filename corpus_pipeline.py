"""The training corpus, from documents, in stages: each works on the rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, mixing, quality, sharding, similar
from tidemark.llm.common import delete, new_path, temporary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted to docs' labelled rows, rejects."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-shingle sets that agree in at least 0.8 of their union.

    The one with the smallest id stays. Texts without words, null ones too, are copies of each other.
    """
    return similar.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, also with other names and numbers."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (up to three times) as their sources' weights ask for; those without words go."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return sharding.shard(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix), ("shard", shard)]

#: SQL can't express the stages' hashes and models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as written. What stages leave behind is deleted once the next one has been written.

    Documents may have more columns, nulls, repeated rows, or no rows at all; the columns shard and slot are the
    result's own.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"documents has the columns {sorted(clash)}, which the result adds")
    for name, stage in STAGES:
        path = new_path(spark, name)
        with temporary(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
