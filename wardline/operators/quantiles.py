"""Exact quantiles of many columns by narrowing down buckets.

A value is placed by a monotone bucket function, buckets are counted, and only the
bucket that holds the wanted rank is looked at more closely.  The first level
uses steps of 1/1024 octave, the second 2**20 equal steps inside the chosen
bucket, and the last one counts the distinct values left there.  Every level is a
scan with a small map-side combined count; no level sorts the data or gathers a
column in one task, and the driver sees a few rows per column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import no_nan
from ..session import durable

STEPS_PER_OCTAVE = 1024
FINE_STEPS = 2**20
LOWEST_OCTAVE = -1075
INFINITE_BUCKET = 4_000_000
KINDS = {
    "variable": pa.int32(), "coarse": pa.int32(), "fine": pa.int32(), "low": pa.float64(),
    "high": pa.float64(), "prob": pa.string(), "side": pa.string(), "rank": pa.int64(),
    "share": pa.float64(),
}


def _log_bucket(value: Column) -> Column:
    """Monotone bucket number of a double, at most a few million of them."""
    size = F.abs(value)
    step = F.floor((F.log2(size) - LOWEST_OCTAVE) * STEPS_PER_OCTAVE) + 1
    number = (
        F.when(size == float("inf"), F.lit(INFINITE_BUCKET))
        .when(size == 0, F.lit(0))
        .otherwise(step)
        .cast("int")
    )
    return F.when(value < 0, -number).otherwise(number)


def _fine_bucket(value: Column, low: Column, high: Column) -> Column:
    inside = F.floor((value - low) / (high - low) * FINE_STEPS)
    return F.when(low == high, F.lit(0)).otherwise(inside).cast("int")


@dataclass(frozen=True)
class Profile:
    """Long form of some columns, and their value counts by coarse bucket.

    ``values`` has a row (variable, value, coarse) per cell, with the column's
    position as variable; missing values have no bucket.  ``buckets`` is small and
    written out, since several results are read from it.
    """

    columns: tuple[str, ...]
    values: DataFrame
    buckets: DataFrame

    def name(self) -> Column:
        """Column name of a row."""
        return F.element_at(F.array(*map(F.lit, self.columns)), F.col("variable") + 1)


def profile(df: DataFrame, columns: Sequence[str]) -> Profile:
    """Count the values of the columns by bucket, in one scan."""
    values = (
        df.select(F.posexplode(F.array(*map(no_nan, columns))).alias("variable", "value"))
        .withColumn("coarse", F.when(F.col("value").isNotNull(), _log_bucket(F.col("value"))))
    )
    buckets = values.groupBy("variable", "coarse").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.sum("value").alias("sum"),
    )
    return Profile(tuple(columns), values, durable(buckets))


def _before(cell: Sequence[str], bucket: str) -> Column:
    """Values of the cell in lower buckets."""
    order = Window.partitionBy(*cell).orderBy(bucket)
    return F.sum("n").over(order) - F.col("n")


def _counted(df: DataFrame, cell: Sequence[str], bucket: str) -> DataFrame:
    counts = df.groupBy(*cell, bucket).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("before", _before(cell, bucket))


def _small_frame(df: DataFrame, rows: Iterable, names: Sequence[str], distinct=False) -> DataFrame:
    """A broadcast table of driver-side rows (a few per column)."""
    tuples = [tuple(r[n] for n in names) for r in rows]
    if distinct:
        tuples = sorted(set(tuples))
    schema = pa.schema([(n, KINDS[n]) for n in names])
    data = {n: [t[i] for t in tuples] for i, n in enumerate(names)}
    return F.broadcast(df.sparkSession.createDataFrame(pa.table(data, schema)))


def _in_bucket() -> Column:
    return (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))


def _wanted(total: Column, probs: dict[str, float]) -> Column:
    """Ranks on both sides of every quantile, with the share of the upper one."""
    wanted = []
    for name, q in probs.items():
        position = (total - 1) * F.lit(q)
        share = (position - F.floor(position)).alias("share")
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            wanted.append(
                F.struct(
                    F.lit(name).alias("prob"), F.lit(side).alias("side"),
                    rank.cast("long").alias("rank"), share,
                )
            )
    return F.array(*wanted)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], known: Profile | None = None
) -> DataFrame:
    """One row per column with the linearly interpolated quantiles ``probs``.

    NULL and NaN are skipped.  Columns without any value have no row.
    """
    known = known or profile(df, columns)
    coarse = known.buckets.filter(F.col("coarse").isNotNull())
    first = (
        coarse.withColumns(
            {
                "before": _before(["variable"], "coarse"),
                "total": F.sum("n").over(Window.partitionBy("variable")),
            }
        )
        .withColumn("t", F.explode(_wanted(F.col("total"), probs)))
        .select("variable", "coarse", "low", "high", "before", "n", "t.*")
        .filter(_in_bucket())
        .withColumn("rank", F.col("rank") - F.col("before"))
        .collect()
    )
    if not first:
        schema = ", ".join(["variable string", *[f"{p} double" for p in probs]])
        return df.sparkSession.createDataFrame([], schema)
    cell = ["variable", "coarse"]
    target = ["prob", "side", "rank", "share"]
    inside = known.values.join(
        _small_frame(df, first, [*cell, "low", "high"], distinct=True), cell
    ).withColumn("fine", _fine_bucket(F.col("value"), F.col("low"), F.col("high")))
    second = (
        _counted(inside, cell, "fine")
        .join(_small_frame(df, first, [*cell, *target]), cell)
        .filter(_in_bucket())
        .withColumn("rank", F.col("rank") - F.col("before"))
        .collect()
    )
    cell = [*cell, "fine"]
    exact = inside.join(_small_frame(df, second, cell, distinct=True), cell)
    found = (
        _counted(exact, cell, "value")
        .join(_small_frame(df, second, [*cell, *target]), cell)
        .filter(_in_bucket())
    )

    def side(prob: str, which: str) -> Column:
        chosen = (F.col("prob") == prob) & (F.col("side") == which)
        return F.max(F.when(chosen, F.col("value")))

    def interpolated(prob: str) -> Column:
        low, high = side(prob, "low"), side(prob, "high")
        share = F.max(F.when(F.col("prob") == prob, F.col("share")))
        return F.when(low == high, low).otherwise(low + (high - low) * share).alias(prob)

    return (
        found.groupBy("variable")
        .agg(*[interpolated(p) for p in probs])
        .withColumn("variable", known.name())
    )
