"""The corpus pipeline: classify, rule, deduplicate, mix, pack. Each stage's result is written as Parquet and read again as the next one's documents.

Stages get what their predecessor kept. Models and rules are fitted on the labelled rows of the raw table, which still holds
bad examples. Defined cases are those of the operators: a text without words goes in the first stage, as does nothing
else for being null; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm.kneser_ney import keep_fluent
from ravelin.llm.mixing import mix
from ravelin.llm.near_dedup import near_dedup
from ravelin.llm.packing import pack
from ravelin.llm.quality_rules import fit as fit_rules
from ravelin.llm.quality_rules import keep_passing
from ravelin.plans.lineage import materialise


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language."""
    return keep_fluent(docs, *_raw(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned rule rejects."""
    return keep_passing(docs, fit_rules(*_raw(spark, sf_dir)))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    return near_dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the blocks that the apportionment to target weights draws."""
    return mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: shard, bin, doc_id, piece, start, n_tokens."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The trained stages can't be put in SQL.
ORACLE_SQL = None
