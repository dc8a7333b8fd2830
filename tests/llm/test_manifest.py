"""Merkle manifest against trees built by hand in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wardline.llm import manifest
from wardline.llm.manifest import BLOCK, FAN, LEVELS, Block, fold, height, leaf_digest, merkle_manifest
from wardline.llm.queries import CAPITALS, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root and the siblings of every leaf, level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for leaf, place in enumerate(at):
            run, k = runs[place // 8], place % 8
            paths[leaf].append((run[:k], run[k + 1 :]))
        at = [p // 8 for p in at]
        level = [sha(*run) for run in runs]
    return level[0], paths


def record(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def expected(docs):
    by = {}
    for doc in docs:
        leaf = record((doc[0], doc[3], doc[2], doc[4], doc[1]))
        text = doc[1].translate(str.maketrans(CAPITALS, CAPITALS.lower())) if doc[1] is not None else None
        hit = doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 3 == 0
        claim = record((doc[0], doc[3], doc[2], doc[4], text)) if hit else leaf
        by.setdefault((doc[2] is not None, (doc[2] or "").encode()), []).append((doc[0] is not None, doc[0] or 0, leaf, claim))
    trees = {lang: (sorted(rows), *tree([r[2] for r in sorted(rows)])) for lang, rows in by.items()}
    root, over = tree([trees[lang][1] for lang in sorted(trees)])
    out = []
    for (_, (rows, subroot, paths)), up in zip(sorted(trees.items()), over, strict=True):
        for (known, doc_id, leaf, claim), path in zip(rows, paths, strict=True):
            steps, at = path + up, claim
            for left, right in steps:
                at = sha(*left, at, *right)
            proof = sha(*[x for left, right in steps for x in left + right])
            out.append((doc_id if known else None, leaf, subroot, root, proof, at, at == root))
    return sorted(out, key=str)


def run(spark, tmp_path, docs):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op13_manifest"](spark, str(tmp_path))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equal_to_trees_by_hand(spark, tmp_path):
    rng = random.Random(5)
    docs = [(k, rng.choice(["Ab c", "äÖ X", "", None, "q" * 3000]), rng.choice(["de", "en", "en", "", None]), "s", k) for k in range(300)]
    docs += [(7, "Equal", "en", None, None)] * 20 + [(None, "No ID", "en", "s", 1)] * 3 + [(900, "Lone", "fr", "s", 1), (-5, "Minus", "de", "s", None)]
    assert run(spark, tmp_path, docs) == expected(docs)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_small_trees(spark, tmp_path, n):
    docs = [(k, f"Text {k}", "en", "s", k) for k in range(n)]
    assert run(spark, tmp_path, docs) == expected(docs)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_several_rounds(spark, monkeypatch, tmp_path):
    """Small blocks: the same digests by three rounds as by one."""
    docs = [(k, f"Text {k}", ["en", "de", None][k % 5 % 3], "s", k) for k in range(700)]
    docs += [(k, "x", f"l{k}", "s", k) for k in range(70)]
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    assert run(spark, tmp_path, docs) == expected(docs)


def test_block_of_one_beside_a_whole_one():
    digests = [sha(str(k)) for k in range(BLOCK + 1)]
    assert height(len(digests)) == LEVELS + 1 and FAN**LEVELS == BLOCK
    root, paths = tree(digests)
    tops = Block([Block(digests[:BLOCK], LEVELS).top, Block(digests[BLOCK:], LEVELS).top], 1)
    assert tops.top == root
    above = tops.paths(2, ())[1]
    (path,) = Block(digests[BLOCK:], LEVELS).paths(1, above)
    assert [("".join(a), "".join(b)) for a, b in paths[-1]] == list(path)
    assert fold(digests[-1], path) == root and fold(sha("other"), path) != root


def test_clashing_columns_and_proofs(spark):
    rows = [(k, k % 2, f"t{k}", k, k, k, k) for k in range(40)]
    frame = spark.createDataFrame(rows, "place long, n long, text string, digest long, tree long, block long, root long")
    found = merkle_manifest(frame, "place", "n", leaf_digest(F.col("text")), proofs=True).collect()
    assert len(found) == 40 and all(r["verified"] for r in found)
    for r in found:
        path = tuple((s["left"], s["right"]) for s in r["proof"])
        assert r["folded_root"] == fold(r["leaf"], path) == r["root"]
        assert r["proof_sha256"] == sha(*[a + b for a, b in path])
