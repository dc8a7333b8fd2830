"""Directory of CSV files, one table each.

Columns are matched by the names in the header, so files may hold more columns
and in any order; only the declared ones are parsed.  Text keeps the difference
between blank (an empty string) and ``NA`` (missing).
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "NA"


def table_name(file_name: str) -> str:
    """Text before the first dot, without blanks."""
    return file_name.split(".")[0].replace(" ", "")


def _typed(field: T.StructField, column: str) -> Column:
    text = F.col(f"`{column}`")
    kind = field.dataType
    if isinstance(kind, T.StringType):
        value = F.nullif(F.coalesce(text, F.lit("")), F.lit(MISSING))
    elif isinstance(kind, T.IntegralType):
        whole = text.try_cast("long")
        value = F.coalesce(whole, text.try_cast("double").try_cast("long")).try_cast(kind)
    else:
        value = text.try_cast(kind)
    return value.alias(field.name)


def read_csv_table(
    spark: SparkSession,
    path: str | list[str],
    schema: str | T.StructType,
    columns: Mapping[str, str] | None = None,
    quoted_line_breaks: bool = True,
) -> DataFrame:
    """One CSV table (a file, a directory of parts or a list of files), typed by ``schema``.

    ``columns`` maps names in the files to those of the schema.  With ``quoted_line_breaks`` quoted fields may hold line
    breaks, and a file is read by one task; without, large files are split among tasks.  Parts whose header differs from the first one's raise an error.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    options = {"header": True, "escape": '"', "multiLine": quoted_line_breaks, "enforceSchema": False}
    text = spark.read.options(**options).csv(path)
    named = {own: name for name, own in (columns or {}).items()}
    lacking = [named.get(f.name, f.name) for f in schema if named.get(f.name, f.name) not in text.columns]
    if lacking:
        raise ValueError(f"{path}: columns not found: {', '.join(lacking)}")
    return text.select(*[_typed(f, named.get(f.name, f.name)) for f in schema])


def csv_files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Table name to files; Spark lists them on any file system, without reading them."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path")
        .toLocalIterator()
    )
    root = unquote(path).rstrip("/").split(":", 1)[-1].lstrip("/")
    tables: dict[str, dict[str, list[str]]] = {}
    for (file,) in found:
        inside = unquote(file).split(root, 1)[1].lstrip("/")
        top = inside.split("/")[0]
        tables.setdefault(table_name(top), {}).setdefault(top, []).append(unquote(file))
    return {name: sorted(tops[max(tops)]) for name, tops in sorted(tables.items())}


def load_csv_dir(
    spark: SparkSession,
    path: str,
    schemas: Mapping[str, str | T.StructType],
    views: bool = True,
    tables: Mapping[str, str] | None = None,
    columns: Mapping[str, Mapping[str, str]] | None = None,
    quoted_line_breaks: Collection[str] | None = None,
) -> dict[str, DataFrame]:
    """Load every ``*.csv`` table under ``path`` that has a schema, as frames and views.

    ``tables`` maps the files' table names to those of ``schemas``, and ``columns`` the files' column names of a table to its
    own.  ``quoted_line_breaks`` names the tables whose text may hold line breaks; the files of all others are
    split among tasks.  None stands for all tables.
    """
    loaded = {}
    for found, files in csv_files(spark, path).items():
        name = (tables or {}).get(found, found)
        if name in schemas:
            breaks = quoted_line_breaks is None or name in quoted_line_breaks
            loaded[name] = read_csv_table(spark, files, schemas[name], (columns or {}).get(name), breaks)
    if views:
        for name, df in loaded.items():
            df.createOrReplaceTempView(name)
    return loaded
