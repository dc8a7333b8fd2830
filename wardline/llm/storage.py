"""Tables and flags shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of two or three fixed-width columns that may be broadcast (under 100 MB in memory).
BROADCAST_ROWS = 1_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if the table, counted now, is small; else as it is, for a shuffled join.

    Use it on narrow tables that are already written or cheap to compute.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
