import hashlib
import math
from collections import Counter

from wardline.llm.mixture import mix_sources


def poisson_at(u, rate):
    p = total = math.exp(-rate)
    k = 0
    while total <= u and k < 500:
        k += 1
        p *= rate / k
        total += p
    return k


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16) / float(1 << 60)


def expected(docs, weights, epochs, seed):
    size = {}
    for _, s, t in docs:
        size[s] = size.get(s, 0) + len((t or "").encode()) + 1
    w = {s: max(0.0, weights.get(s, 0.0)) if weights is not None else math.sqrt(b) for s, b in size.items()}
    out = Counter()
    for d, s, t in docs:
        rate = w[s] / sum(w.values()) * sum(size.values()) * epochs / size[s]
        parts = max(1, math.ceil(rate / 32))
        name = d if d is not None else "-" + hashlib.md5((t or "").encode()).hexdigest()
        n = sum(poisson_at(draw(seed, name, k + 1), rate / parts) for k in range(parts))
        out[d, s, t] += n
    return +out


def rows():
    docs = [(k, f"s{k % 3}", "text " * (k % 7)) for k in range(300)]
    docs += [(900 + k, "rare", "few") for k in range(4)]
    return docs + [(None, "s0", "no id"), (None, "s0", None), (7, None, "no source"), (8, None, None), (1, "s1", "text ")]


def test_counts(spark):
    docs = rows()
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    for weights, epochs in ((None, 1.0), ({"s0": 1.0, "rare": 3.0, "s1": -2.0, "absent": 5.0, None: 0.5}, 2.0)):
        w = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight double")
        if weights is not None:
            weights = {k: v for k, v in weights.items() if k != "absent"}
        got = mix_sources(d, w, epochs=epochs, seed=3).collect()
        assert Counter((r.doc_id, r.source, r.text) for r in got) == expected(docs, weights, epochs, 3)
        assert all(r.copy >= 1 for r in got)


def test_order_and_columns(spark):
    d = spark.createDataFrame([(k, "s", "t" * 9, 1) for k in range(2000)], "doc_id long, source string, text string, copy int")
    mixed = mix_sources(d, epochs=3.0)
    assert mixed.columns == ["doc_id", "source", "text", "copy", "shuffle_key"]
    got = mixed.collect()
    assert 5700 < len(got) < 6300
    counts = Counter(Counter(r.doc_id for r in got).values())
    assert abs(counts[3] - 2000 * math.exp(-3) * 4.5) < 120
    assert sorted(r.doc_id for r in got) != [r.doc_id for r in got]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix_sources(d).collect() == []
