"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated Poisson(rate of s) times, with rate = target share x wanted bytes / bytes of s.
The count inverts the distribution at a hash of the document, so every document decides
for itself and again alike, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small, written

#: Larger rates are sums of independent Poisson counts of at most this rate, which keeps exp(-rate) exact.
RATE_STEP = 32.0
POWER = 0.5


def _hash60(*parts: Column) -> Column:
    """A whole number below 2^60 from an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_rates(docs: DataFrame, source: str, text: str, weights: DataFrame | None, epochs: float) -> DataFrame:
    """``source``, ``rate`` (mean count) and the distribution to invert, for every source of the documents."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("bytes", F.lit(POWER)))
    else:
        given = weights.groupBy(F.col("source").alias("s")).agg(F.sum("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, ["weight"])
    sizes = written(sizes.withColumn("weight", F.greatest("weight", F.lit(0.0))), "sources")
    all_bytes, all_weight = sizes.agg(F.sum("bytes"), F.sum("weight")).first()
    share = F.col("weight") / (all_weight or 1.0) * ((all_bytes or 0.0) * epochs)
    rates = sizes.withColumn("rate", share / F.col("bytes"))
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / RATE_STEP), F.lit(1)).cast("int"))
    rates = rates.withColumn("each", F.col("rate") / F.col("parts"))
    # cumulative probabilities until nothing is left in double precision
    most = F.ceil(F.col("each") + F.sqrt("each") * 12 + 24).cast("int")
    start = F.exp(-F.col("each"))
    zero = F.struct(start.alias("p"), start.alias("sum"), F.array(start).alias("upto"))
    step = lambda a, k: F.struct(
        (a["p"] * F.col("each") / k).alias("p"),
        (a["sum"] + a["p"] * F.col("each") / k).alias("sum"),
        F.array_append(a["upto"], a["sum"] + a["p"] * F.col("each") / k).alias("upto"),
    )
    return rates.select("source", "rate", "parts", F.aggregate(F.sequence(F.lit(1), most), zero, step)["upto"].alias("upto"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    epochs: float = 1.0,
    seed: int = 11,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Documents repeated to target weights, in a global random order.

    ``weights`` has columns ``source`` and ``weight`` (share of the bytes, in any unit); a source without a row, or with a weight
    below zero, has weight 0.  Without it the weight is the square root of the source's bytes.  The
    expected bytes of the result are ``epochs`` times those of the documents.

    The columns of ``docs`` and ``copy`` (1, 2, ...) and ``shuffle_key``, a hash of the copy by which rows are
    dealt to partitions and sorted in them; columns of these names are replaced.  A null
    source is a source of its own.  Rows of equal id are repeated equally often; rows without id
    are told apart by their text.  A null text has no bytes and counts one, as all texts do for their end.
    """
    carry = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rates = small(written(source_rates(docs, source, text, weights, epochs), "rates"), 10_000)
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(source).alias("of"),
        name.alias("name"),
    )
    rows = rows.join(rates, F.col("of").eqNullSafe(F.col("source")))
    draw = lambda part: _hash60(F.lit(seed), F.col("name"), part) / float(1 << 60)
    below = lambda part: F.size(F.filter("upto", lambda p: p <= draw(part)))
    single = F.size(F.filter("upto", lambda p: p <= F.col("u")))
    rows = rows.withColumn("u", draw(F.lit(1)))
    several = F.aggregate(F.sequence(F.lit(2), F.greatest("parts", F.lit(2))), single, lambda a, k: a + below(k))
    rows = rows.withColumn("count", F.when(F.col("parts") == 1, single).otherwise(several)).filter("count > 0")
    rows = rows.select("row", "name", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count").cast("long"))).alias("copy"))
    key = _hash60(F.lit(seed), F.col("name"), F.col("copy"), F.lit("order"))
    mixed = rows.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return mixed.select("row.*", "copy", "shuffle_key")
