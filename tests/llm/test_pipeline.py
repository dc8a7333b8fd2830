"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import brute as matches
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_mixture import expected as repeats
from wardline.llm.queries import table, toxicity_model

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


def test_stages(spark, tmp_path):
    docs = table(spark, str(FOLDER), "documents")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, str(FOLDER)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        texts = {r.doc_id: r.text for r in before}
        kept = Counter(r.doc_id for r in after)
        assert all(texts[r.doc_id] == r.text for r in after)
        if name != "sharding":
            assert docs.columns == columns
        if name == "toxicity":
            scorer = toxicity_model(table(spark, str(FOLDER), "documents"), table(spark, str(FOLDER), "labels")).scorer()
            assert set(kept) == {d for d, t in texts.items() if scorer.score(t) < 0.3}
            assert len(after) > 0.8 * len(before)
        elif name == "jaccard":
            assert sorted(kept) == sorted(d for d, _, c in groups(list(texts.items())) if c == d)
        elif name == "decontamination":
            items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
            assert set(kept) == {d for d, _, n, _ in matches(list(texts.items()), items, 10) if n == 0}
        elif name == "mixture":
            rows = [(r.doc_id, r.source, r.text) for r in before]
            assert kept == Counter({d: n for (d, _, _), n in repeats(rows, None, 1.0, 11).items()})
        else:
            assert kept == Counter(r.doc_id for r in before)
            slots = {}
            for r in after:
                slots.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run(spark):
    rows = pipeline.run(spark, str(FOLDER))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(rows.columns)
    assert rows.count() > 0
