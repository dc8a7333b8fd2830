"""From raw documents to shards: toxic texts, near copies and benchmark passages go, sources are mixed, rows are sharded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm.decontaminate import remove_contaminated
from wardline.llm.jaccard import one_per_component
from wardline.llm.mixture import mix_sources
from wardline.llm.queries import SHARDS, table, toxicity_model
from wardline.llm.sharding import shard_texts
from wardline.llm.storage import written
from wardline.llm.toxicity import THRESHOLD, remove_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the compression classifier calls toxic go."""
    return remove_toxic(docs, toxicity_model(docs, table(spark, folder, "labels")), THRESHOLD)


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of similar texts stays."""
    return one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return remove_contaminated(docs, table(spark, folder, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents are repeated so that sources weigh the square root of their size."""
    return mix_sources(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents get a shard and a place in it."""
    return shard_texts(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("jaccard", deduplicate),
    ("decontamination", decontaminate),
    ("mixture", mix),
    ("sharding", shard),
]

#: No SQL form: toxicity is a trained model; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and read again."""
    docs = table(spark, folder, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if number < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
