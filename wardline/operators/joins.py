"""Join of a large fact table with a cohort-sized lookup table.

A lookup table with a counted, bounded number of fixed-width rows is broadcast.
Beyond that bound both sides are shuffled, and keys that own very many facts are
split into several join keys first, so that no task gets a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

BROADCAST_ROWS = 1_000_000
HOT_KEY_ROWS = 5_000_000


def is_small(lookup: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the table, counted now, has at most ``rows`` rows."""
    return lookup.count() <= rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    small: bool,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Inner join on ``key``; fan-out over several lookup rows per key is kept."""
    if small:
        return facts.join(F.broadcast(lookup), key)
    return split_join(facts, lookup, key, hot_rows)


def split_join(
    facts: DataFrame, lookup: DataFrame, key: str, hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Shuffled inner join in which a key with n facts is spread over n / hot_rows splits.

    The hot keys are found first, by a count of the key column, and written out since
    both sides read them.  Their list has at most (facts / hot_rows) rows and is
    counted before it is broadcast; too long a list only raises ``hot_rows``.  The lookup side
    grows by at most as many rows.  The split of a fact is a hash of its content and of its
    input partition: a repeated task gives the same answer, and equal copies from
    different input splits are spread too.
    """
    facts = facts.filter(F.col(key).isNotNull())
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = durable(counts.filter(F.col("_rows") > hot_rows))
    while not is_small(hot):  # only with more than BROADCAST_ROWS hot keys
        hot_rows *= 2
        hot = hot.filter(F.col("_rows") > hot_rows)
    hot = hot.select(key, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_splits"))
    splits = F.coalesce("_splits", F.lit(1))
    spread = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_split",
        F.pmod(F.xxhash64(F.spark_partition_id(), *facts.columns), splits).cast("int"),
    )
    copies = lookup.join(F.broadcast(hot), key, "left").withColumn(
        "_split", F.explode(F.sequence(F.lit(0), splits - 1))
    )
    return spread.drop("_splits").join(copies.drop("_splits"), [key, "_split"]).drop("_split")
