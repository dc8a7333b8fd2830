"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Nodes up to which their labels go to all tasks, so that a round shuffles nothing but one aggregate.
FEW_NODES = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of ``links`` (columns ``a``, ``b``); the label is the smallest node reached.

    Labels spread to neighbours and then jump to the label of the label, so the number of
    rounds grows with the logarithm of the longest path.  Every round is written to the checkpoint folder.
    Nulls link nothing; without links the result is empty.
    """
    links = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    # every node is a neighbour of its own, so that one join brings its label and those around it; the links are computed once
    ways = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"]
    both = durable(links.select(F.inline(F.array(*ways))).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"))
    few = labels.limit(FEW_NODES + 1).count() <= FEW_NODES
    while True:
        near = labels.select(F.col("node").alias("b"), F.col("label").alias("around"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        if few:
            near, ahead = F.broadcast(near), F.broadcast(ahead)
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("around")))
        spread = both.join(near, "b").groupBy("a").agg(own.alias("old"), F.min("around").alias("label"))
        after = durable(spread.join(ahead, "label").select(F.col("a").alias("node"), "old", F.least("label", "next").alias("label")))
        changed = after.filter("old <> label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
