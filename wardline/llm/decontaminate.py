"""Benchmark decontamination with suffix arrays.

Every task builds suffix arrays over the words of its share of the documents (about a million
words each) and searches all windows of the test items in them by halving, all windows
at once.  The documents are never shuffled and a text never leaves its row.

Test items are sent to the tasks in blocks of at most ``block_bytes`` of text; the blocks are
searched one after the other, so the size of the benchmark is not bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixes import Queries, Shard
from .words import LETTERS, Words, slices, text_bytes

WINDOW = 10
BLOCK_BYTES = 32 << 20
_SPANS = "array<struct<start:bigint,n:bigint>>"


def _covered(places: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + sizes, -1)
    return np.cumsum(steps[:-1]) > 0


def _lists(values: pa.Array, of: np.ndarray, n: int) -> pa.Array:
    """Lists by row; ``of`` is the ascending row of each value."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def _hits(column: pa.Array, spans: pa.Array, items: pa.Array, queries: Queries) -> tuple:
    """Word counts, hit spans and items of some texts, joined to what earlier blocks found."""
    rows = len(column)
    words = Words(*text_bytes(column), LETTERS)
    n = len(words.hashes)
    if n and len(queries.at):
        shard = Shard(words, queries.depth)
        text_of = shard.text_of
        places, which = shard.occurrences(queries)
    else:
        text_of = np.repeat(np.arange(rows), np.diff(words.bounds))
        places = which = np.zeros(0, np.int64)
    sizes = queries.size[which]
    found = pa.array(queries.ids, pa.string())
    # the distinct items of each text
    pairs = np.unique(text_of[places] * max(1, len(queries.size)) + which) if len(places) else places
    text, window = np.divmod(pairs, max(1, len(queries.size)))
    counts = queries.item_from[window + 1] - queries.item_from[window]
    slot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    item = queries.item_of[slot + np.repeat(queries.item_from[window], counts)]
    pairs = np.unique(np.repeat(text, counts) * max(1, len(queries.ids)) + item)
    text, item = np.divmod(pairs, max(1, len(queries.ids)))
    items_now = _lists(found.take(pa.array(item)), text, rows)
    if items is not None:  # a later block: earlier finds are joined
        items_now = pa.array(
            [sorted({*a, *b}) for a, b in zip(items.to_pylist(), items_now.to_pylist(), strict=True)],
            pa.list_(pa.string()),
        )
        old = np.repeat(np.arange(rows), np.diff(spans.offsets.to_numpy()))
        old_start = spans.flatten().field(0).to_numpy() + words.bounds[old]
        places = np.concatenate([places, old_start])
        sizes = np.concatenate([sizes, spans.flatten().field(1).to_numpy()])
    hit = _covered(places, sizes, n)
    # stretches of hit words inside a text
    before = np.zeros(n, bool)
    before[1:] = hit[:-1] & (text_of[1:] == text_of[:-1])
    start = np.flatnonzero(hit & ~before)
    after = np.zeros(n, bool)
    after[:-1] = hit[1:] & (text_of[1:] == text_of[:-1])
    size = np.flatnonzero(hit & ~after) + 1 - start
    stretches = pa.StructArray.from_arrays(
        [pa.array(start - words.bounds[text_of[start]], pa.int64()), pa.array(size, pa.int64())], ["start", "n"]
    )
    return pa.array(np.diff(words.bounds), pa.int64()), _lists(stretches, text_of[start], rows), items_now


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list]:
    """The items in blocks of at most ``limit`` bytes; a single larger item is a block."""
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).dropna()
    size = F.octet_length("t") + F.octet_length("i") + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    parts = max(1, math.ceil(2 * total / limit))
    for k in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        block, held = [], 0
        for i, t in mine.toLocalIterator():
            block.append((i, t))
            held += len(t.encode()) + len(i) + 16
            if held >= limit:
                yield block
                block, held = [], 0
        if block:
            yield block


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Verbatim matches of test items in documents.

    A match is a run of ``window`` words (or a shorter whole item) of a test item.  One row per
    document row, in place: the columns in ``carry`` (all when None) and ``n_words``, ``n_hit``
    (words inside a match), ``hit_spans`` (start and length in words of the stretches of
    hit words) and ``item_ids`` (sorted strings).  Carried columns of these names are replaced.

    A null or empty text has no words and no hits.  Items with a null id, or without words,
    match nothing; rows of equal id are one item.  Repeated documents are each reported.
    """
    added = ["n_words", "n_hit", "hit_spans", "item_ids"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    context = docs.sparkSession.sparkContext
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    frame = docs.select(row.alias("row"), F.col(text).alias("text"))
    blocks = list(_block_queries(benchmark, item, item_text, window, block_bytes, context))
    for number, block in enumerate(blocks):
        last = number == len(blocks) - 1

        def search(batches, block=block, last=last):
            queries = block.value
            for batch in batches:
                for part in slices(batch, 1):
                    old = part.num_columns > 2
                    counts, spans, items = _hits(
                        part.column(1), part.column(3) if old else None, part.column(4) if old else None, queries
                    )
                    text = pa.nulls(part.num_rows, pa.string()) if last else part.column(1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), text, counts, spans, items], ["row", "text", "n_words", "hit_spans", "item_ids"]
                    )

        frame = frame.mapInArrow(
            search, f"row {_quoted(frame)}, text string, n_words bigint, hit_spans {_SPANS}, item_ids array<string>"
        )
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return frame.select(*[F.col(f"row.`{c}`") for c in carry], "n_words", n_hit.alias("n_hit"), "hit_spans", "item_ids")


def _quoted(frame: DataFrame) -> str:
    """The DDL of the struct column ``row``."""
    fields = frame.schema["row"].dataType.fields
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields) + ">"


def _block_queries(benchmark, item, item_text, window, block_bytes, context):
    any_block = False
    for block in _blocks(benchmark, item, item_text, block_bytes):
        any_block = True
        yield context.broadcast(Queries(block, window))
    if not any_block:
        yield context.broadcast(Queries([], window))


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The longest verbatim match of every suffix of every test item, and one place of it.

    Columns ``item_id`` (string), ``item_start`` (word), ``n_words``, ``doc_id``, ``doc_start`` (word);
    suffixes without any match are left out.  Of equal lengths the smallest document
    id, then the first place, is given.  Word hashes of 64 bits stand for the words.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema[doc_id].dataType.simpleString()
    found = None
    for block in _block_queries(benchmark, item, item_text, 1, block_bytes, context):

        def search(batches, block=block):
            queries = block.value
            owners = np.repeat(np.arange(len(queries.words.bounds) - 1), np.diff(queries.words.bounds))
            for batch in batches:
                for part in slices(batch, 1):
                    words = Words(*text_bytes(part.column(1)), LETTERS)
                    if not len(words.hashes) or not len(queries.words.hashes):
                        continue
                    shard = Shard(words, queries.depth)
                    ids = pc.rank(part.column(0), sort_keys="ascending", null_placement="at_start", tiebreaker="min")
                    at, size, where = shard.longest(queries, ids.to_numpy())
                    doc = shard.text_of[where]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(queries.texts, pa.string()).take(pa.array(owners[at])),
                            pa.array(at - queries.words.bounds[owners[at]], pa.int64()),
                            pa.array(size, pa.int64()),
                            part.column(0).take(pa.array(doc)),
                            pa.array(where - words.bounds[doc], pa.int64()),
                        ],
                        ["item_id", "item_start", "n_words", "doc_id", "doc_start"],
                    )

        one = docs.select(doc_id, text).mapInArrow(
            search, f"item_id string, item_start bigint, n_words bigint, doc_id {kind}, doc_start bigint"
        )
        found = one if found is None else found.unionAll(one)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_start"))
    return found.groupBy("item_id", "item_start").agg(best.alias("b")).select(
        "item_id", "item_start", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.doc_start"
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents without any match, with their columns as they came."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = benchmark_hits(inner, benchmark, carry=["row"], **options)
    return found.filter("n_hit = 0").select("row.*")
