"""A corpus pipeline of five stages; each reads what its predecessor wrote.

Quality rules drop what they reject; SimHash near-duplicates keep one document of each group;
decontamination drops documents with a leaked benchmark passage; personal data is replaced by
placeholders; mixing samples documents towards the target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import decontam, mixing, pii, quality, simhash
from marketlens.llm.common import prepare, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.keep_one(docs, shingle=3, bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.sample(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("personal data", personal_data),
          ("mixing to target weights", mix)]
#: No SQL: fingerprints, alignments and fitted weights can't be stated in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
