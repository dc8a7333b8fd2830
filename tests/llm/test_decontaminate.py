import random
import re

import numpy as np
import pytest

from wardline.llm.decontaminate import benchmark_hits, longest_matches, remove_contaminated
from wardline.llm.suffixes import suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    """doc -> (n_words, n_hit, items) by comparing every window with every place."""
    windows = [(str(i), tuple(w[k : k + window])) for i, t in items if i is not None and (w := words(t)) for k in range(max(1, len(w) - window + 1))]
    out = []
    for doc, text in docs:
        mine, hit, found = words(text), set(), set()
        for i, win in windows:
            for k in range(len(mine) - len(win) + 1):
                if tuple(mine[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(i)
        out.append((doc, len(mine), len(hit), sorted(found)))
    return sorted(out, key=str)


def hits(spark, docs, items, window=4, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = benchmark_hits(d, b, window=window, **options).collect()
    assert all(sum(s.n for s in r.hit_spans) == r.n_hit for r in rows)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in rows), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = ["a", "b", "Cé", "d-", "averyveryverylongword", "averyveryverylongwork", "1x", "ünd"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(1, 12))) for k in range(12)] + [(3, "same id twice b a"), (None, text(9)), (50, None), (51, "..."), (52, "")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, " .,; "), (103, "A B  cÉ\n" * 50), (5, docs[5][1]), (None, items[2][1]), (104, "zz " + items[5][1] + " zz")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_hits_equal_brute_force(spark, corpus, block):
    docs, items = corpus
    assert hits(spark, docs, items, block_bytes=block) == brute(docs, items, 4)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert hits(spark, [], items) == []
    assert all(r[2:] == (0, []) for r in hits(spark, docs, []))


def test_columns_and_removal(spark):
    docs = spark.createDataFrame([(1, "x y z w v", "keep"), (2, "p q r s t u", "go"), (3, None, None)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(9, "q R s. T")], "item_id long, text string")
    got = benchmark_hits(docs, bench, window=4)
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "hit_spans", "item_ids"]
    assert {r.doc_id: (r.n_hit, r.text, r.item_ids) for r in got.collect()} == {1: (0, "x y z w v", []), 2: (4, "p q r s t u", ["9"]), 3: (0, None, [])}
    clean = remove_contaminated(docs, bench, window=4)
    assert clean.columns == docs.columns
    assert sorted(clean.collect()) == sorted(docs.filter("doc_id <> 2").collect())


def test_longest_matches(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame([x for x in docs if x[0] is not None], "doc_id long, text string")
    b = spark.createDataFrame([x for x in items if x[0] != 3], "item_id long, text string")
    got = {(r.item_id, r.item_start): (r.n_words, r.doc_id, r.doc_start) for r in longest_matches(d, b).collect()}
    texts = {k: words(t) for k, t in docs}
    by_id = {str(i): words(t) for i, t in items if i is not None and i != 3}
    for i, mine in by_id.items():
        for at in range(len(mine)):
            best = 0
            for k, text in docs:
                w = words(text) if k is not None else []
                for p in range(len(w)):
                    n = 0
                    while at + n < len(mine) and p + n < len(w) and mine[at + n] == w[p + n]:
                        n += 1
                    best = max(best, n)
            n, doc, p = got.get((i, at), (0, None, 0))
            assert n == best
            if n:
                assert any(words(t)[p : p + n] == mine[at : at + n] for k, t in docs if k == doc)
    assert texts


def test_the_place_of_a_longest_match_does_not_depend_on_partitions(spark):
    """Of copies in one shard, in the order 9, 3, 5, the smallest id is given for every suffix; then the first place."""
    text = "one two three four five"
    rows = [(9, text), (3, "zero one. " + text + " " + text), (5, text), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("a", text), ("b", "nine four five"), ("c", None), (None, text)], "item_id string, text string")
    expected = [("a", k, 5 - k, 3, 2 + k) for k in range(5)] + [("b", 1, 2, 3, 5), ("b", 2, 1, 3, 6)]
    for parts in (1, 5):
        found = longest_matches(docs.repartition(parts), bench)
        assert sorted(tuple(r) for r in found.collect()) == expected
    unnamed = docs.unionByName(spark.createDataFrame([(None, text)], docs.schema)).coalesce(1)
    assert {r["doc_id"] for r in longest_matches(unnamed, bench).collect()} == {None}
    assert longest_matches(docs.limit(0), bench).count() == 0


def test_suffix_array_sorts_all_suffixes():
    rng = np.random.default_rng(1)
    for vocabulary in (1, 2, 5, 3_000_000):
        counts = [0, 1, 30, 7, 30]
        rank = rng.integers(1, vocabulary + 1, sum(counts))
        left = np.concatenate([np.arange(c, 0, -1) for c in counts])
        suffix = lambda i: tuple(rank[i : i + left[i]])  # noqa: E731, B023
        order = suffix_array(rank, left, 64)
        assert sorted(order) == list(range(len(rank)))
        assert [suffix(i) for i in order] == sorted(map(suffix, range(len(rank))))


def test_long_text(spark):
    text = "lorem ipsum dolor " * 400_000 + "one two three four five"
    rows = hits(spark, [(1, text)], [(7, "two three four five")])
    assert rows == [(1, 1_200_005, 4, ["7"])]
