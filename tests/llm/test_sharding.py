import random
import zlib

import pytest
from pyspark.sql import functions as F

from wardline.llm.sharding import shard_texts, write_shards


def check(rows, docs, shards, slack):
    """Every row once, slots without gaps, sums of bytes nearly equal."""
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(docs, key=str)
    held = [0] * shards
    slots = {}
    for r in rows:
        held[r.shard] += size(r.text)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, most = sum(held), max((size(t) for _, t in docs), default=0)
    assert all(abs(h - total / shards) <= most + slack for h in held)


@pytest.mark.parametrize("hot", [0, 700])
def test_law(spark, hot):
    rng = random.Random(4)
    docs = [(k, "é" * rng.randint(0, 90) + str(k)) for k in range(1500)]
    docs += [(10_000 + k, "the same text " * 5) for k in range(hot)]
    docs += [(5, None), (None, "no id"), (None, None), (6, ""), (7, "x" * 3000), (8, docs[3][1]), docs[9], docs[9]]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = shard_texts(d, 16).collect()
    check(rows, docs, 16, 0)
    again = shard_texts(d.repartition(3), 16).collect()
    place = lambda rs: sorted(((r.doc_id, r.text, r.shard, r.slot) for r in rs), key=str)
    assert place(rows) == place(again)
    copies = {r.shard for r in rows if r.text == "the same text " * 5}
    assert len(copies) <= 2 + 16 * hot // 2000


def test_empty_and_few(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, slot int")
    assert shard_texts(d, 4).collect() == []
    one = spark.createDataFrame([(1, "a", 9)], "doc_id long, text string, slot int")
    rows = shard_texts(one, 4)
    assert rows.columns == ["doc_id", "text", "shard", "slot"]
    assert [tuple(r) for r in rows.collect()] == [(1, "a", 0, 0)]
    write_shards(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_crc(spark):
    text = "žluť"
    got = spark.range(1).select(F.crc32(F.lit(text))).first()[0]
    assert got == zlib.crc32(text.encode())
