"""The training-data pipeline: five stages from documents to mixed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsift.llm import decontaminate, mixing, near_text, pii, toxicity
from runsift.llm.storage import store


#: The first stage has removed toxic documents, so none are asked for here.
MIX = {"q1t0": 0.9, "q0t0": 0.1, "q1t1": 0.0, "q0t1": 0.0}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return near_text.drop_near_duplicates(docs, width=5, similarity_pct=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts; n_chars follows."""
    clean = pii.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate; documents of rate 0 go."""
    return mixing.mix(docs, _table(spark, sf_dir, "labels"), targets=MIX).where("rate > 0")


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The learned stages have no SQL twin; tests compare the others with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
