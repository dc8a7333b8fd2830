"""Result sinks: each writes one directory, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and no row names; missing values are written as NA, times with microseconds."""
    options = {
        "header": True,
        "nullValue": "NA",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    }
    df.write.mode(mode).options(**options).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
