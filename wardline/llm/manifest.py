"""Merkle manifest of a table: a digest of every row, a root over all, and a proof for each row.

Trees are evaluated by time-forward processing.  Nodes are labelled (level, place); a node sends its digest to
its parent's label, and a priority queue hands messages out in the order of labels, so that a parent finds all
its children's digests together.  Spark's external sort is the queue between rounds: nodes of one tree are
dealt in blocks of 8^4 consecutive places, a round turns each block into its top, and the tops are the
nodes of the next round.  Inside a block a heap takes that part.  The reversed sweep goes from
the last round to the first and hands every node the path above it; leaves get their proofs and fold them.

Only tops of blocks (one in 4,096 rows) are held more than once; no task holds more than one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .storage import small

#: Children of a node, and the levels of a block.
FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS

Step = tuple[str, str]  # digests of the siblings to the left and to the right, in a row


def digest(*parts: str) -> str:
    """Lower-case hex SHA-256 of the parts in a row."""
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Block:
    """Consecutive nodes of one tree and what lies above them, up to ``levels`` levels."""

    def __init__(self, digests: list[str], levels: int):
        self.levels = levels
        self.runs: dict[tuple[int, int], list[str]] = {}  # children by the label of their parent
        queue = [(1, place // FAN, place, d) for place, d in enumerate(digests)] if levels else []
        self.top = digests[0]
        while queue:  # ordered as built: already a heap
            level, place = queue[0][:2]
            run = []
            while queue and queue[0][:2] == (level, place):
                run.append(heapq.heappop(queue)[3])
            self.runs[level, place] = run
            up = digest(*run)
            if level < levels:
                heapq.heappush(queue, (level + 1, place // FAN, place, up))
            else:
                self.top = up

    def paths(self, n: int, above: tuple[Step, ...]) -> list[tuple[Step, ...]]:
        """The steps from each of the n nodes to the last root, ``above`` being those from the top on."""
        known = {(self.levels, 0): above}
        for level in range(self.levels, 0, -1):  # labels downwards: parents deliver to their children
            below = n if level == 1 else -(-n // FAN ** (level - 1))
            for place in range(below):
                run, k = self.runs[level, place // FAN], place % FAN
                step = ("".join(run[:k]), "".join(run[k + 1 :]))
                known[level - 1, place] = (step, *known[level, place // FAN])
        return [known[0, place] for place in range(n)]


def fold(leaf: str, path: tuple[Step, ...]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one (tree, block); rows come sorted by both and place."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
        at = 0
        for k in range(1, len(keys) + 1):
            if k < len(keys) and keys[k] == keys[at]:
                continue
            if held and keys[at] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[at]
            held.append(batch.slice(at, k - at))
            at = k
    if held:
        yield pa.Table.from_batches(held)


def _levels(n: int) -> int:
    return min(LEVELS, height(n))


def _arranged(nodes: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Nodes by block, in order; with ``info`` the row of the path above its top comes first in every block."""
    rows = nodes.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    if info is not None:
        heads = info.withColumn("block", F.col("place")).withColumn("place", F.lit(-1).cast("long"))
        rows = rows.unionByName(heads, allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _forward(nodes: DataFrame) -> DataFrame:
    """The tops of all blocks, as nodes of the next round."""

    def work(batches):
        for block in _blocks(batches):
            n = block["n"][0].as_py()
            levels = _levels(n)
            top = Block(block["digest"].to_pylist(), levels).top
            yield pa.RecordBatch.from_arrays(
                [block["tree"].chunk(0).slice(0, 1), block["block"].chunk(0).slice(0, 1),
                 pa.array([-(-n // FAN**levels)], pa.int64()), pa.array([top])],
                ["tree", "place", "n", "digest"],
            )

    kind = nodes.schema["tree"].dataType.simpleString()
    blocks = _arranged(nodes.select("tree", "place", "n", "digest"))
    return durable(blocks.mapInArrow(work, f"tree {kind}, place long, n long, digest string"))


_PATH = "array<struct<left:string,right:string>>"
_PATHS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _opened(block: pa.Table) -> tuple[pa.Table, tuple[Step, ...], list[tuple[Step, ...]], dict[str, str]]:
    """Nodes of a block, the path above its top, the path of each node, and the roots."""
    head, block = block.slice(0, 1).to_pylist()[0], block.slice(1)
    above = tuple((s["left"], s["right"]) for s in head["path"])
    paths = Block(block["digest"].to_pylist(), _levels(block["n"][0].as_py())).paths(len(block), above)
    return block, above, paths, {name: head[name] for name in ("subroot", "root")}


def _path_column(paths: list[tuple[Step, ...]]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], _PATHS)


def _downward(nodes: DataFrame, info: DataFrame) -> DataFrame:
    """The path above every node of a round: ``tree``, ``place``, ``path``, ``subroot``, ``root``."""

    def work(batches):
        for block in _blocks(batches):
            block, _, paths, roots = _opened(block)
            out = block.select(["tree", "place"]).append_column("path", _path_column(paths))
            for name, value in roots.items():
                out = out.append_column(name, pa.array([value] * len(block), pa.string()))
            yield from out.to_batches()

    kind = nodes.schema["tree"].dataType.simpleString()
    blocks = _arranged(nodes.select("tree", "place", "n", "digest"), info)
    return blocks.mapInArrow(work, f"tree {kind}, place long, path {_PATH}, subroot string, root string")


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, and the root of every tree."""
    rounds, tops = [nodes], _forward(nodes)
    while tops.filter("n > 1").limit(1).count():
        rounds.append(tops)
        tops = _forward(tops)
    return rounds, tops


def _placed(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Rows with ``place`` (from 0) in their tree and the tree's count ``n``, after one range shuffle.

    Ranges cut anywhere, also inside one tree, one key or equal rows.  The counts have one row for each partition and tree in it.
    """
    rows = durable(rows.withColumn("_tie", F.monotonically_increasing_id()))
    order = [F.col(tree).asc_nulls_first(), *order, F.col("_tie").asc()]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(rows.repartitionByRange(count, *order).sortWithinPartitions(*order).drop("_tie"))
    at = F.monotonically_increasing_id()  # partition << 33 | row of the checkpointed partition
    numbered = ranged.withColumns({"_pid": F.spark_partition_id(), "_row": at.bitwiseAND((1 << 33) - 1)})
    counts = numbered.groupBy("_pid", tree).agg(F.count(F.lit(1)).alias("_m"), F.min("_row").alias("_first"))
    by = Window.partitionBy(tree)
    before = F.sum("_m").over(by.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    counts = durable(counts.select(
        F.col("_pid").alias("_q"), F.col(tree).alias("_tree"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_m").over(by).alias("n"),
    ))
    found = numbered.join(small(counts), (F.col("_pid") == F.col("_q")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return found.withColumn("place", F.col("_row") + F.col("_shift")).drop("_pid", "_row", "_q", "_tree", "_shift")


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def merkle_manifest(
    rows: DataFrame, key: str, tree: str, leaf: Column, presented: Column | None = None, proofs: bool = False
) -> DataFrame:
    """One row per row: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Leaves of a ``tree`` value ascend by ``key``, nulls first, then by leaf.  While several nodes remain, every 8
    consecutive ones become the digest of their digests (a last run of one too).  The results are the
    subroots; ordered by tree value (null first, bytewise) they give the root alike.  ``proof_sha256`` is the digest of all
    siblings from the leaf up, left to right; with ``proofs`` the column ``proof`` lists them as pairs (left, right) by level.
    ``folded_root`` is computed from ``presented``, a digest that somebody claims for the row (null or not given: the leaf),
    and the siblings; ``verified`` says that it is the root.

    Rows may repeat; of equal ones each has its own place.  A null tree value is a tree of its own, an empty string another.
    An empty table gives an empty result.  Extra columns of any name are not read.
    """
    claim = leaf if presented is None else F.coalesce(presented, leaf)
    leaves = rows.select(F.col(key).alias("key"), F.col(tree).alias("tree"), leaf.alias("digest"), claim.alias("claim"))
    nodes = _placed(leaves, "tree", [F.col("key").asc_nulls_first(), F.col("digest").asc(), F.col("claim").asc()])
    rounds, subroots = _rounds(nodes)

    over = _placed(subroots.select("tree", "digest").withColumn("all", F.lit(0)), "all", [F.col("tree").asc_nulls_first()])
    over = durable(over.select(F.col("all").alias("tree"), F.col("tree").alias("value"), "digest", "place", "n"))
    upper, root = _rounds(over)
    empty = F.array().cast(_PATH)
    info = root.select("tree", "place", empty.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for part in reversed(upper):
        info = _downward(part, info)
    info = durable(info.join(small(over.select("place", "value", "digest")), "place").select(
        F.col("value").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"
    ))
    for part in reversed(rounds[1:]):
        info = durable(_downward(part, info))

    def work(batches):
        for block in _blocks(batches):
            block, above, paths, roots = _opened(block)
            out = block.select(["key", "digest"]).rename_columns(["key", "leaf"])
            tail = "".join(a + b for a, b in above)
            heads = ("".join(a + b for a, b in p[: len(p) - len(above)]) for p in paths)
            columns = {name: [value] * len(block) for name, value in roots.items()}
            columns["proof_sha256"] = [digest(h, tail) for h in heads]
            columns["folded_root"] = [fold(c, p) for c, p in zip(block["claim"].to_pylist(), paths, strict=True)]
            for name, values in columns.items():
                out = out.append_column(name, pa.array(values, pa.string()))
            if proofs:
                out = out.append_column("proof", _path_column(paths))
            yield from out.to_batches()

    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    found = _arranged(nodes, info).mapInArrow(work, schema + (f", proof {_PATH}" if proofs else ""))
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)
