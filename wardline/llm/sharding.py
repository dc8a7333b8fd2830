"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by a key hash (equal keys stand together) and then by a hash of the id.  A sample in which a row's
chance follows its size gives the quantile boundaries of many key ranges.  A range that still holds too
many bytes, for example one hot key, is divided further by the id hash.  The cells so
made are sorted one by one; exact byte offsets of the cells place every row on a global
scale, which is cut into equal shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .storage import small

RANGES_PER_SHARD = 16
#: More data gives more ranges, up to MOST_RANGES; beyond it ranges grow.
RANGE_BYTES, MOST_RANGES = 256 << 20, 1 << 16
SAMPLES_PER_RANGE = 32


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are not above the key; two short scans instead of one long one."""
    if not splitters:
        return F.lit(0).cast("long")
    step = math.isqrt(len(splitters)) + 1
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    not_above = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    coarse = not_above(longs(splitters[::step]))
    fine = not_above(F.slice(longs(splitters), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine).cast("long")


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a sample of about 32 rows a range, drawn by size."""
    chance = F.col("_size") * (float(ranges * SAMPLES_PER_RANGE) / max(1, total))
    drawn = F.pmod(F.xxhash64("_key", "_tie", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    keys = rows.filter(drawn < chance).agg(F.sort_array(F.collect_list("_key")).alias("k")).first()["k"]
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def _placed(rows: DataFrame, cells: DataFrame, total: int, shards: int) -> DataFrame:
    """Adds the global row number and the shard."""
    order = Window.partitionBy("_range", "_part").orderBy("_key", "_tie")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_row": F.row_number().over(order), "_upto": F.sum("_size").over(upto)})
    rows = rows.join(F.broadcast(cells), ["_range", "_part"])
    # the shard in which the first byte of the row falls; decimals since the product can be large
    start = (F.col("_from") + F.col("_upto") - F.col("_size")).cast("decimal(38,0)")
    shard = F.floor(start * shards / F.lit(max(1, total)).cast("decimal(20,0)")).cast("int")
    return rows.withColumns({"_global": F.col("_rows") + F.col("_row") - 1, "_shard": F.least(shard, F.lit(shards - 1))})


def shard_rows(df: DataFrame, shards: int, size: Column, key: Column, tie: Column) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0 without gaps within the shard).

    Shards hold nearly equal sums of ``size`` (positive whole numbers): they differ by at most the size of
    one row.  Rows of equal ``key`` stand next to each other, so they share a shard unless a
    boundary falls among them.  ``tie`` orders rows of equal key; rows equal in both have to be of equal size
    and may change places with each other.  Nulls in key and tie are a value like any other.  Columns of
    ``df`` named ``shard`` or ``slot`` are replaced; an empty table stays empty.

    The driver gets one sample of bounded size and one row per range.
    """
    carry = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        size.cast("long").alias("_size"),
        F.xxhash64(key).alias("_key"),
        F.xxhash64(tie, F.lit(5)).alias("_tie"),
    )
    slim = durable(rows.select("_size", "_key", "_tie"))
    total = slim.agg(F.sum("_size")).first()[0] or 0
    ranges = min(max(RANGES_PER_SHARD * shards, -(-total // RANGE_BYTES)), MOST_RANGES)
    splitters = _splitters(slim, total, ranges)
    ranged = lambda d: d.withColumn("_range", _range_of(F.col("_key"), splitters))
    # overfull ranges are divided; the list has at most as many rows as there are ranges
    usual = max(1, total // max(1, ranges))
    full = ranged(slim).groupBy("_range").agg(F.sum("_size").alias("_bytes")).filter(F.col("_bytes") > 2 * usual)
    full = durable(full.select("_range", F.ceil(F.col("_bytes") / usual).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64("_tie"), F.coalesce("_parts", F.lit(1))).cast("int")
    divided = lambda d: ranged(d).join(F.broadcast(full), "_range", "left").withColumn("_part", part).drop("_parts")
    # a few cells a range: a table of bounded size
    cells = divided(slim).groupBy("_range", "_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = durable(
        cells.select(
            "_range", "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_from"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"),
        )
    )
    firsts = _placed(divided(slim), cells, total, shards).groupBy("_shard").agg(F.min("_global").alias("_first"))
    firsts = small(durable(firsts))
    placed = _placed(divided(rows), cells, total, shards).join(firsts, "_shard")
    return placed.select("row.*", F.col("_shard").alias("shard"), (F.col("_global") - F.col("_first")).alias("slot"))


def shard_texts(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in shards of nearly equal bytes; a text counts its UTF-8 bytes plus one, a null text one.

    Equal texts stand together.  See ``shard_rows``.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    return shard_rows(docs, shards, size, F.coalesce(F.col(text), F.lit("")), F.col(doc_id))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; rows of a file are in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
