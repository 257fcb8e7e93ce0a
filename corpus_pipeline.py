"""A training corpus made of the documents table, stage by stage.

Each stage is (name, function) and the function takes (spark, docs, sf_dir).
Its result is written as Parquet and read again as the next one's docs; all but
the last return the columns of docs.  Toxic documents go, of exact copies the
smallest identifier stays, of each group of near copies too; the mix then
repeats documents of small sources (it leaves none out: its budget is the
smallest at which the largest source is taken once), and the last stage lays
what is left along the curve and packs it.

Cases: nulls, empty and long texts, ties, repeated rows and clashing columns
fare in a stage as its operator's docstring says; a row without text is no copy
of another and stays, to be packed with 0 words; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from inkwell.llm.common import ensure_checkpoint_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, budget=None, temper=0.7)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier, signatures and curve keys have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
