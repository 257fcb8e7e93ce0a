"""The queries of this subpackage, over whole tables with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import chat_templates, cotraining, exact_dedup, grammar_ids, ivfpq, mixing, near_dedup, packing, suffix_tree, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.score(_table(spark, sf_dir, "documents"))
    return out.withColumns({"log_prob": F.round("log_prob", 4), "bits_per_symbol": F.round("bits_per_symbol", 6)})


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_ids.grammar_shards(_table(spark, sf_dir, "documents"))


def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_copies(_table(spark, sf_dir, "documents"))


def op5_chat_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_templates.render_conversations(_table(spark, sf_dir, "conversations"))
    spans = F.transform("spans", lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return out.withColumn("spans", F.array_join(spans, ","))


def op6_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_ivfpq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.neighbours(_table(spark, sf_dir, "embeddings"))


def op9_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_tree_scores, op2_hilbert_packing, op3_grammar_shards, op4_pareto_mixing, op5_chat_rendering,
        op6_minhash_classes, op7_exact_dedup, op8_ivfpq_neighbours, op9_cotrained_quality, op10_toxicity,
    )
}

SQL: dict[str, str] = {"op1_suffix_tree_scores": suffix_tree.SQL, "op4_pareto_mixing": mixing.SQL, "op5_chat_rendering": chat_templates.SQL, "op7_exact_dedup": exact_dedup.SQL}
