"""The training-data pipeline: stages in order, each a function of (spark, docs, sf_dir).

Documents of no known language go; of each group of near duplicates the one of the smallest doc_id stays; documents
that hold a benchmark item go; secrets are masked in the texts; and the rest is sampled to target weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgraph.llm import decontam, langid, mixing, secrets, simhash
from symbolgraph.llm.common import boxed, read_table, shared_folder

#: A document goes if no language makes up this share of it.
LEAST_SHARE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(langid.training_rows(docs))
    found = boxed(docs, found=langid.identify_column("text", model))
    return found.where((F.col("found.lang") != langid.UNKNOWN) & (F.col("found.score") >= LEAST_SHARE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]

#: Mixture inference, edit-distance search and calibrated sampling aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
