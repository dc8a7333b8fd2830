"""Exact similarity join on word shingles: which documents are linked, and their groups.

1.  One pass counts shingles that are frequent within a task's share of the text.  A fixed number of the
    most frequent ones go last in the global order of shingles; the order does not change results.
2.  One pass turns texts into sets.  Equal sets get one node.  Each node keeps its prefix (the first
    quarter of its shingles in the global order: two similar sets share several of them) and a few
    band keys of neighbouring hashes.
3.  Sets that share a band key are compared with one hub each.  These links form first components.
4.  The prefixes form index lists; lists within one component are skipped whole.  Where lists are long, their sets
    form families: each is compared with one set only, the centre of the largest component that its lists meet, and keeps the
    overlap, the shingles gained and those lost.  Links to centres join more components.
    Large families then move to the member that differs least from all others.
5.  Pairs within a family are answered from the centre: their overlap follows from theirs with it and from the shingles that set both
    apart from it.  What each lacks of the centre is common in a dense group and what it has beyond it is rare, so pairs meet by the latter;
    only where sets shorter than the centre can be similar without it do they meet by what they lack.
6.  For all other pairs the lists are cut into blocks by set size, and a set visits only the blocks that its size and
    its position in the list can reach.  What is met often enough is compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .components import components
from .storage import small, written
from .words import VISIBLE, Words, mix, shingles, slices, text_bytes

SHINGLE = 5
PERCENT = 80
#: Shingles of the list of frequent ones: at most this many occurrences' share each, so at most so many.
FREQUENT = 1 << 20
#: Occurrences within about 1 MB of text from which a shingle is reported as frequent.
LOCALLY_FREQUENT = 3
BANDS, BAND_SIZE = 8, 3
#: Shingles that a prefix holds beyond the shortest possible one, in percent of the set.  Two similar sets
#: then share one shingle more than that in their prefixes, which settles most candidates.
SLACK = 3
#: Ratio of the set sizes of one block of an index list.
BLOCK = 1.12
#: Sets of an index list from which they are compared with a centre first.
LONG_LIST = 16
#: Shared shingles asked for before two sets of a family are compared.
FEW = 6


def _sorted_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by text and hash, their text, and n + 1 bounds."""
    h, text = shingles(Words(*text_bytes(column), VISIBLE), size)
    key = text.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)
    order = np.argsort(key)
    k, g = key[order], h[order]
    if ((k[1:] == k[:-1]) & (g[1:] != g[:-1])).any():
        order = np.lexsort((h, text))
        g = h[order]
    t = text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    g, t = g[new], t[new]
    return g, t, np.searchsorted(t, np.arange(len(column) + 1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def frequent_shingles(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Hashes of frequent shingles, rarest first; at most FREQUENT of them reach the driver."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 0):
                h, _ = shingles(Words(*text_bytes(part.column(0)), VISIBLE), size)
                values, counts = np.unique(h, return_counts=True)
                often = counts >= LOCALLY_FREQUENT
                total = pa.array(np.append(counts[often], len(h)), pa.int64())
                name = pa.concat_arrays([_signed(values[often]), pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays([name, total], ["h", "n"])

    counts = durable(
        docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    )
    total = counts.filter("h is null").agg(F.max("n")).first()[0] or 0
    least = max(16, -(-total // FREQUENT))
    rows = counts.filter(F.col("h").isNotNull() & (F.col("n") >= least)).toArrow()
    values = rows["h"].to_numpy().view(np.uint64)
    return values[np.lexsort((values, rows["n"].to_numpy()))]


class Sets:
    """Sets of some texts, with the prefix and the band keys of each."""

    def __init__(self, column: pa.Array, size: int, percent: int, last: np.ndarray, last_rank: np.ndarray):
        self.h, self.text, self.bounds = _sorted_sets(column, size)
        self.n = np.diff(self.bounds)
        self.full = np.flatnonzero(self.n)
        at = self.bounds[:-1][self.full]
        self.node = np.zeros(len(self.n), np.uint64)
        if len(at):
            self.node[self.full] = mix(np.add.reduceat(mix(self.h), at) ^ self.n[self.full].astype(np.uint64))
        self.percent, self.last, self.last_rank = percent, last, last_rank

    def prefixes(self) -> pa.Array:
        """The first n - ceil(percent n / 100) + 1 + slack shingles in the global order, as lists."""
        slot = np.searchsorted(self.last, self.h)
        known = slot < len(self.last)
        known[known] = self.last[slot[known]] == self.h[known]
        step = self.h >> np.uint64(21)
        step[known] = np.uint64(1 << 43) | self.last_rank[slot[known]].astype(np.uint64)
        key = self.text.astype(np.uint64) << np.uint64(44) | step
        order = np.argsort(key)
        if (key[order][1:] == key[order][:-1]).any():
            order = np.lexsort((self.h, key))
        size = np.where(self.n > 0, self.n + (-self.percent * self.n) // 100 + 1 + self.n * SLACK // 100, 0)
        first = np.arange(len(self.h)) - np.repeat(self.bounds[:-1], self.n) < np.repeat(size, self.n)
        offsets = np.concatenate([[0], np.cumsum(size)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(self.h[order][first]))

    def bands(self) -> pa.Array:
        """Hashes of a few neighbours in the set from some fixed places on, going round."""
        keys = np.empty((len(self.full), BANDS), np.uint64)
        at, n = self.bounds[:-1][self.full], self.n[self.full]
        key = self.text.astype(np.uint64) << np.uint64(44) | self.h >> np.uint64(20)
        for band in range(BANDS):
            start = np.uint64(band * (2**44 // BANDS))
            place = np.searchsorted(key, self.full.astype(np.uint64) << np.uint64(44) | start) - at
            out = np.full(len(at), band, np.uint64)
            for k in range(BAND_SIZE):
                out = mix(out ^ self.h[at + (place + k) % n])
            keys[:, band] = out
        offsets = np.concatenate([[0], np.cumsum(np.where(self.n > 0, BANDS, 0))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(keys.reshape(-1)))


def _sets(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """One row per document row: ``id``, ``n``, ``node``, ``bands``, ``prefix``."""
    hot = frequent_shingles(docs, text, size)
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def work(batches):
        last, last_rank = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                s = Sets(part.column(1), size, percent, last, last_rank)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s.n, pa.int64()), _signed(s.node), s.bands(), s.prefixes()],
                    ["id", "n", "node", "bands", "prefix"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    frame = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return written(
        frame.mapInArrow(work, f"id {kind}, n long, node long, bands array<long>, prefix array<long>"), "sets"
    )


def _full_sets(docs: DataFrame, doc_id: str, text: str, size: int, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``items``: the whole set of every node asked for, from one document each."""
    ids = sets.groupBy("node").agg(F.min("id").alias("id")).join(nodes.distinct(), "node", "left_semi")
    ids = small(durable(ids))
    nodes, wanted = ids.select("node"), ids.select(F.col("id").alias("rep"))
    frame = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    frame = frame.join(wanted, F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("text")

    def work(batches):
        for batch in batches:
            for part in slices(batch, 0):
                s = Sets(part.column(0), size, 100, np.zeros(0, np.uint64), np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(s.bounds, pa.int32()), _signed(s.h))
                yield pa.RecordBatch.from_arrays([_signed(s.node), lists], ["node", "items"])

    found = frame.mapInArrow(work, "node long, items array<long>")
    return written(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "items")


def _overlaps(pairs: DataFrame, items: DataFrame, apart: bool = False) -> DataFrame:
    """``pairs`` (columns ``a``, ``b`` and more) with the size ``o`` of the intersection; ``apart`` adds the sizes of both and what only ``b`` has (``gained``) or only ``a`` (``lost``)."""
    left = items.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = items.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    found = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("ia", "ib")).cast("long"))
    if apart:
        only = {"gained": F.array_except("ib", "ia"), "lost": F.array_except("ia", "ib")}
        found = found.withColumns({"na": F.size("ia").cast("long"), "nb": F.size("ib").cast("long")} | only)
    return found.drop("ia", "ib")


def _similar(o: Column, na: Column, nb: Column, percent: int) -> Column:
    return o * 100 >= (na + nb - o) * percent


def _block(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BLOCK))).cast("int")


def _several(postings: DataFrame) -> DataFrame:
    """Postings of lists that hold sets of different components; a null component is the set alone, which keeps rows small."""
    of = F.coalesce("comp", "node")
    lists = postings.groupBy("h").agg(F.min(of).alias("low"), F.max(of).alias("high"))
    return postings.join(lists.filter("low < high").select("h"), "h", "left_semi").withColumn("comp", of)


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the component of their node, null without links."""
    labels = labels.select(F.col("node").alias("_n"), F.col("label").alias("comp"))
    return rows.join(labels, F.col("node") == F.col("_n"), "left").drop("_n")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of the nodes (``node``, ``label``) after more ``links`` (``a``, ``b``), which are contracted to components first."""
    if links.isEmpty():
        return labels
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = durable(labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("label", F.col("node"))))
    tight = links.select("a", "b")
    for side in ("a", "b"):
        of = nodes.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        tight = tight.join(of, F.col(side) == F.col("_n")).withColumn(side, F.col("_l")).drop("_n", "_l")
    top = small(components(tight.distinct())).withColumnsRenamed({"node": "_n", "label": "_l"})
    return durable(nodes.join(top, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label")))


def _families(open_: DataFrame, labels: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """The centre that each set of a long list is to be compared with: ``a`` (centre), ``b``.

    A component's centre is the hub with the most links.  A list stands for its largest component; a set goes to the
    centre of similar size that most of its lists stand for, and to none if these are fewer than similar sets share in their prefixes.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    hubs = stars.join(labels.withColumnRenamed("node", "a"), "a").groupBy("label", "a", "na").agg(F.count(F.lit(1)).alias("n"))
    centres = hubs.groupBy("label").agg(F.max(F.struct("n", "a", "na")).alias("m")).join(sizes, "label")
    centres = small(durable(centres.select(F.col("label").alias("comp"), F.col("m.a").alias("centre"), F.col("m.na").alias("nc"), "size")))
    long = open_.groupBy("h").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") >= LONG_LIST).select("h")
    long = open_.join(long, "h", "left_semi").join(centres, "comp", "left")
    best = F.struct(F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("centre", "node").alias("a"), F.coalesce("nc", "n").alias("na"))
    stands = long.groupBy("h").agg(F.max(best).alias("best")).select("h", "best.a", "best.na")
    votes = long.select("h", F.col("node").alias("b"), F.col("n").alias("nb")).join(stands, "h")
    votes = votes.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("n"))
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("n") > F.least("na", "nb") * SLACK / 100)
    chosen = votes.filter(near).groupBy("b").agg(F.max(F.struct("n", "a")).alias("m"))
    return durable(chosen.select(F.col("m.a").alias("a"), "b"))


def _needed(nx: Column, ny: Column, percent: int) -> Column:
    """The least overlap of similar sets of these sizes."""
    return F.ceil((nx + ny) * percent / (100 + percent))


def _compared(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Members ``b`` of families with their centre ``a``."""
    return _overlaps(pairs, items, apart=True).select(
        F.col("b").alias("node"), F.col("nb").alias("n"), F.col("a").alias("fam"), "na", F.col("o").alias("inside"), "gained", "lost"
    )


def _recentred(family: DataFrame, items: DataFrame) -> DataFrame:
    """The families, large ones around the member that differs least from all: what many have beyond a centre is then rare.

    What x and y do not share sums over all y to many * |Dx| - 2 * (how often the elements of Dx occur), but for a constant; D is what
    only one of a member and the centre has, so the centre's own sum is 0.
    """
    many = family.groupBy("fam").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") >= LONG_LIST)
    rows = family.join(many, "fam").select("fam", "node", "many", F.explode(F.concat("gained", "lost")).alias("h"))
    often = rows.groupBy("fam", "h").agg(F.count(F.lit(1)).alias("often"))
    sums = rows.join(often, ["fam", "h"]).groupBy("fam", "node").agg(F.sum(F.col("many") - 2 * F.col("often")).alias("s"))
    best = sums.filter("s < 0").groupBy("fam").agg(F.min(F.struct("s", "node")).alias("m"))
    best = small(durable(best.select("fam", F.col("m.node").alias("a"))))
    if best.isEmpty():
        return family
    moved = family.select("fam", F.col("node").alias("b")).join(best, "fam").select("a", "b")
    return durable(family.join(best, "fam", "left_anti").unionByName(_compared(moved, items)))


def _rarest_first(rows: DataFrame, items: Column) -> DataFrame:
    """A row for each of the items ``h`` of a set of a family, with ``free``, the places from there on.

    Items that bring no two components together go first and are left out, then the rarest come.  Written, as both sides of a join read it.
    """
    rows = rows.withColumns({"h": F.explode(items), "d": F.size(items)}).drop("gained", "lost")
    lists = rows.groupBy("fam", "h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("many"))
    rows = rows.join(lists.filter("low < high").select("fam", "h", "many"), ["fam", "h"])
    of = Window.partitionBy("fam", "node")
    place = F.col("d") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("many", "h")) - 1
    return durable(rows.withColumn("free", F.col("d") - place))


def _meetings(x: DataFrame, y: DataFrame, which: Column) -> DataFrame:
    """Sets of a family that have an item in common, side by side."""
    columns = ("node", "n", "na", "comp", "inside", "far", "short", "free")
    x, y = (f.select("fam", "h", *[F.col(c).alias(c + s) for c in columns]) for f, s in ((x, "x"), (y, "y")))
    return x.join(y, ["fam", "h"]).filter(which)


def _family_pairs(family: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one family that can be similar, by what they and the centre do not share.

    With I, G and L = what a set has of the centre, has beyond it and lacks of it, the overlap of x and y is at most min(|Ix|, |Iy|) + |Gx and Gy|.
    So similar sets share g = need - min(|Ix|, |Iy|) elements of G, and k of them (FEW, or g if that is less) lie among the first
    |G| - g + k places of both.
    For g <= 0: the overlap is |Ix| + |Iy| - n(centre) + |Dx and Dy| with D = G and L, so t = need + n(centre) - |Ix| - |Iy| elements of D are
    shared, to be met in the same way.  t <= 0 cannot be: both would be similar to the centre, so of one component.  One of both is not,
    its overlap with the centre less than they need.  So the other is smaller than the centre, and both have ``percent`` of them in it.
    """
    far = ~_similar(F.col("inside"), F.col("na"), F.col("n"), percent)
    short = (F.col("n") < F.col("na")).alias("short")
    rows = durable(family.select("fam", "na", "node", "n", "comp", "inside", far.alias("far"), short, "gained", "lost"))
    nx, ny = F.col("nx"), F.col("ny")
    beyond = _needed(nx, ny, percent) - F.least("insidex", "insidey")
    larger = (nx > ny) | ((nx == ny) & (F.col("nodex") > F.col("nodey")))
    near = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent

    def met(x: DataFrame, y: DataFrame, shared: Column, which: Column) -> DataFrame:
        k = F.least(shared, F.lit(FEW))
        found = _meetings(x, y, (F.col("compx") != F.col("compy")) & near & which & (F.least("freex", "freey") > shared - k))
        found = found.groupBy("nodex", "nx", "nodey", "ny").agg(F.count(F.lit(1)).alias("n"), F.first(k).alias("k")).filter("n >= k")
        return durable(found.select(F.col("nodex").alias("x"), "nx", F.col("nodey").alias("y"), "ny"))

    gained = _rarest_first(rows, F.col("gained"))
    both = _rarest_first(rows.filter((F.col("inside") * 100 >= F.col("n") * percent) & (F.col("far") | F.col("short"))), F.concat("gained", "lost"))
    apart = _needed(nx, ny, percent) + F.col("nax") - F.col("insidex") - F.col("insidey")
    once = larger | ~(F.col("shortx") & F.col("fary"))
    return met(gained, gained, beyond, (beyond > 0) & larger).unionByName(
        met(both.filter("far"), both.filter("short"), apart, (beyond <= 0) & once)
    )


def _candidates(open_: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of sets of different components that index lists bring together often enough.

    Similar sets of sizes nx >= ny share ``need`` = ceil(percent (nx + ny) / (100 + percent)) shingles.
    So ``k`` of them (k = 1 + the slack of the smaller set) lie among the first nx - need + k
    places of the one set and the first ny - need + k of the other.  Later places are not
    visited, and the larger set visits only blocks of sizes from percent / 100 of its own up to its own.  Pairs of one family are
    left to it.
    """
    reach = F.col("n") - F.col("pos")
    least = F.greatest(F.ceil(F.col("n") * percent / 100), F.lit(1))
    large = open_.select(
        "h",
        F.explode(F.sequence(_block(least) - 1, _block(F.col("n")))).alias("block"),
        F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), reach.alias("rx"), F.col("fam").alias("fx"),
    )
    less = open_.select(
        "h", _block(F.col("n")).alias("block"), F.col("node").alias("y"), F.col("n").alias("ny"),
        F.col("comp").alias("cy"), reach.alias("ry"), F.col("fam").alias("fy"),
    )
    k = F.lit(1) + F.floor(F.col("ny") * SLACK / 100)
    need = _needed(F.col("nx"), F.col("ny"), percent)
    met = large.join(less, ["h", "block"]).filter(
        (F.col("cx") != F.col("cy"))
        & ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x"))))
        & (F.least("rx", "ry") > need - k)
        & (F.col("ny") >= need)
        & ~F.coalesce(F.col("fx") == F.col("fy"), F.lit(False))
    )
    counts = met.groupBy("x", "nx", "y", "ny").agg(F.count(F.lit(1)).alias("shared"))
    return counts.filter(F.col("shared") >= k).drop("shared")


def jaccard_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """Groups of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    One row per document row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest
    document id that links reach.  Words are what ASCII white space separates, after lower-casing
    A-Z.  A text of fewer words than ``size`` is one shingle; a text without words, or null, is linked
    with nothing and is its own component.  Equal texts are linked.  The id may be null: such
    rows take part, and their component is the smallest id there, or null.  Sets and shingles
    are told apart by 64-bit hashes.
    """
    rows = _labelled(docs, doc_id, text, size, percent)
    first = rows.filter("n > 0").groupBy("label").agg(F.min("id").alias("least"))
    return rows.join(first, "label", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )


def _labelled(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document row: ``id``, ``n``, ``node`` and ``label``, which tells the groups of rows with words apart."""
    sets = _sets(docs, doc_id, text, size, percent)
    full = sets.filter("n > 0")

    # links to hubs: of the sets with a band key in common, the one whose keys are the most common
    bands = full.select("node", "n", F.explode("bands").alias("band")).distinct()
    common = bands.groupBy("band").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    bands = durable(bands.join(common, "band"))
    central = bands.groupBy("node").agg(F.sum("many").alias("central"))
    hubs = bands.join(central, "node").groupBy("band").agg(F.max(F.struct("central", "node", "n")).alias("hub"))
    hubs = hubs.select("band", F.col("hub.node").alias("a"), F.col("hub.n").alias("na"))
    near = bands.join(hubs, "band").filter("node <> a").select("a", "na", F.col("node").alias("b"), F.col("n").alias("nb"))
    near = near.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    # one common key is weak evidence; what is passed over here is left to the index lists
    near = near.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("keys")).filter("keys > 1").drop("keys")
    near = durable(near)
    items = _full_sets(docs, doc_id, text, size, sets, near.select(F.col("a").alias("node")).unionAll(near.select("b")))
    stars = durable(_overlaps(near, items).filter(_similar(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "na", "b"))
    labels = small(components(stars))

    # index lists of several components
    postings = _relabelled(full.select("node", "n", "prefix"), labels)
    postings = postings.select("node", F.col("n").cast("int").alias("n"), "comp", F.posexplode("prefix").alias("pos", "h"))
    open_ = written(_several(postings).distinct(), "postings")

    # families: one comparison for each set of a long list
    pairs = _families(open_, labels, stars, percent)
    items = _full_sets(docs, doc_id, text, size, sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    first = durable(_compared(pairs, items))
    family = _recentred(first, items)
    links = first.unionByName(family).filter((F.col("node") != F.col("fam")) & _similar(F.col("inside"), F.col("na"), F.col("n"), percent))
    labels = small(_merged(labels, durable(links.select(F.col("fam").alias("a"), F.col("node").alias("b")).distinct())))

    # pairs of different components
    family = family.filter(F.col("inside") * 2 >= F.greatest("n", "na"))
    open_ = _several(_relabelled(open_.drop("comp"), labels)).join(small(family.select("node", "fam")), "node", "left")
    found = _family_pairs(_relabelled(family, labels).withColumn("comp", F.coalesce("comp", "node")), percent)
    pairs = durable(_candidates(open_, percent).unionByName(found).select(F.col("x").alias("a"), F.col("y").alias("b"), "nx", "ny").distinct())
    items = _full_sets(docs, doc_id, text, size, sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links = _overlaps(pairs, items).filter(_similar(F.col("o"), F.col("nx"), F.col("ny"), percent)).select("a", "b")

    labels = small(_merged(labels, durable(links)))
    return sets.select("id", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents with one row of each component kept: that of the smallest id, and of its rows that of the smallest hash.

    Columns stay as they are.  Rows, not ids, are decided on: rows of one id with texts that are not linked each stay or
    go with their own component.  A null id comes after all others.  Rows without words are kept.  Rows are told apart by
    their id and a 64-bit hash of all columns; of rows that are equal in everything one stays.
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    key = F.xxhash64(*[c.cast("string") for c in every], *[c.isNull() for c in every])
    rid = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), key.alias("key")).alias("rid")
    groups = _labelled(docs.select(rid, F.col(text).alias("text")), "rid", "text", **options)
    groups = durable(groups.filter("n > 0").select("id", "label"))
    several = groups.groupBy("label").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    several = small(durable(several.filter("rows > 1").select("label", "least")))
    gone = groups.join(several, "label").filter("id <> least").select(F.col("id").alias("gone")).distinct()
    repeated = groups.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("id").alias("many"))
    gone, repeated = small(durable(gone)), small(durable(repeated))
    left = docs.select(F.struct(*every).alias("row"), rid).join(gone, F.col("rid") == F.col("gone"), "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    one = left.join(repeated, F.col("rid") == F.col("many"), "left_semi").groupBy("rid").agg(F.first("row").alias("row"))
    rest = left.join(repeated, F.col("rid") == F.col("many"), "left_anti")
    return rest.select("row.*").unionByName(one.select("row.*"))
