"""Training-data pipeline: toxicity, near duplicates, benchmark passages, personal data, mix.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next one's
``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longform.llm import decontam, mixing, pii, simhash, toxicity
from longform.llm.common import crc_fold, free_name, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; learned as in the toxicity query, on this stage's documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 4) != 2)
    score = free_name("_toxicity", docs)
    scored = toxicity.score_documents(docs, model, score_col=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one_per_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pii.pseudonymize(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit_mix(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates),
          ("benchmark_decontamination", drop_benchmark), ("pii_pseudonyms", hide_personal_data),
          ("source_mixing", mix_sources)]

# Zstandard dictionaries, SimHash and Feistel rounds have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
