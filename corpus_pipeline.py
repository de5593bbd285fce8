"""A corpus pipeline of five stages over ``documents``.

Quality classifier, exact dedup, near-dedup, decontamination, mix: each stage takes (spark,
docs, sf_dir), works on all that the stage before it kept, and returns whole rows. All but
the last return the columns of ``documents``; the last adds ``mix_epoch`` and ``mix_words``,
one row for each copy that the mix takes of a document and the number of its words that
count towards the budget of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontaminate, mixing, quality
from tablewright.llm.exact_dedup import ExactDedup
from tablewright.llm.near_dedup import NearDedup
from tablewright.storage import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labels of these documents, rejects."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return ExactDedup(docs).survivors()


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their shingles of five words, the one with the smallest doc_id stays.

    Five words are the rule for stages on shingles; the query op5_near_duplicates has four, as it is asked to.
    """
    return NearDedup(docs).survivors()


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: sources weigh 3, 1, 2, repeating, and share 150% of all words."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Compressed sizes, the forest and the tiling have no form in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return docs
