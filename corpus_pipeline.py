"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlens.llm import minhash, mixing, packing, pii, quality
from strandlens.llm.common import table, written
from strandlens.llm.queries import tokenizer_path


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer keeps."""
    return quality.keep_good(docs, threshold=0.5, sample=4096)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data; n_chars follows the new text."""
    done = pii.surrogates(docs, key="strandlens-surrogates-1", count_col=None)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in done.columns else done


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to shares of n_docs ** 0.5, copies shuffled globally."""
    return mixing.poisson_mix(docs, temperature=0.5, epochs=1.0, seed=2).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1,024 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), size=1024, end_id=2)


STAGES = [
    ("quality classifier", stage_quality),
    ("near-duplicates", stage_near_duplicates),
    ("personal data", stage_personal_data),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: A trained scorer, sketches and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and reread,
    so that a lost executor repeats one stage's tasks at most."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
