"""A corpus pipeline: quality rules, near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents. ORACLE_SQL is None as SQL can't express the stages; tests hold them
against brute force.

Defined results, for every stage: null texts are empty ones (which the first stage
rejects); texts are read whole; rows that are repeated are judged one by one, and near_dedup
keeps one of them; an empty table goes through as one; columns of any other name pass
through all stages but the last. Ties, null ids and null sources: see the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm import near, packing, pii, quality, repeats
from patternlake.llm.common import free_names, named
from patternlake.sources.store import remove, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id."""
    return near.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the byte strings of 200 that occur elsewhere too."""
    *_, kept = free_names(docs, *repeats.RESULTS)
    left = repeats.remove_repeats(docs)
    return _with_length(left.select(*[F.col(kept).alias(c) if c == "text" else named(c) for c in docs.columns]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return _with_length(pii.mask_pii(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in the bins."""
    return packing.pack_documents(docs)


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what lies between them goes to the shared checkpoint folder.

    A stage's rows are deleted when the next stage's have been written; the last ones stay, as the result reads them.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
