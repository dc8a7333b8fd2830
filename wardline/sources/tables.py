"""Warehouse tables, views and SQL over frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def warehouse_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by name, or a parquet dataset when ``name`` is a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def frame_sql(query: str, **frames: DataFrame) -> DataFrame:
    """SQL text over frames, named in braces: ``frame_sql("select * from {t}", t=df)``."""
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(query, **frames)
