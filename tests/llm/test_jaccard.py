import random
import re

import pytest

from wardline.llm import jaccard
from wardline.llm.components import components
from wardline.llm.jaccard import jaccard_components, one_per_component

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute(docs):
    """Components by comparing all pairs of rows."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            o = len(a & b)
            if a and b and 100 * o >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(docs):
        r = root(k)
        known = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(known, default=None)
    return sorted(((d, len(sets[k]), least[root(k)]) for k, (d, _) in enumerate(docs)), key=str)


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    passage = text(60)
    texts = [text(rng.randint(0, 120)) for _ in range(80)]
    texts += near_copies(rng, text(150), 60, 8)  # most are linked, some only through others
    texts += near_copies(rng, text(60), 40, 3)
    texts += [text(30) + " " + passage + " " + text(30) for _ in range(60)]
    texts += [text(2) + " " + passage for _ in range(30)]
    texts += [texts[3]] * 30 + ["A b C", "a B c", "a b d", "", None, " \n", "x", "x"]
    base = text(200).split()
    for k in range(25):  # a chain: neighbours are linked, the ends are not
        texts.append(" ".join(base[2 * k : 2 * k + 100]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, texts[3]), (None, "nothing like it"), (None, "nothing like it"), (2, texts[2])]


def test_equal_to_all_pairs(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(d).collect()), key=str)
    assert got == brute(docs)


def test_dense_groups_with_few_common_bands(spark, monkeypatch):
    """2,000 near copies, most of which no band brings together; sets around the limit; and a second, shifted centre."""
    monkeypatch.setattr(jaccard, "BANDS", 2)
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))
    shifted = " ".join([*base.split()[:110], *[f"s{k}" for k in range(40)]])
    texts = near_copies(rng, base, 1400, 6) + near_copies(rng, shifted, 500, 6) + near_copies(rng, base, 100, 14)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pairs = []
    real = jaccard._overlaps
    monkeypatch.setattr(jaccard, "_overlaps", lambda p, *a, **k: pairs.append(p.count()) or real(p, *a, **k))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(d).collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) > 100  # some sets stay alone
    assert sum(pairs) < 30 * len(rows), pairs


def test_one_of_each_stays(spark, docs):
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, node long")
    kept = one_per_component(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    expected = {c for i, n, c in brute(docs) if n and c is not None} | {i for i, n, _ in brute(docs) if not n}
    assert {i for i in ids if i is not None} == {i for i in expected if i is not None}
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_rows_decide_not_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))
    alone = [(7, text()) for _ in range(40)]  # one id, texts that resemble nothing
    first, second, third = text(), text(), text()
    rows = alone + [(1, first), (7, first), (None, first), (None, second), (None, second + " end"), (8, third), (8, third), (9, third)]
    rows += [(7, ""), (7, None), (7, None), (None, " ")]
    kept = one_per_component(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=str)
    assert [r for r in got if r[1] in (second, second + " end")] in ([(None, second)], [(None, second + " end")])
    got = [r for r in got if r[1] not in (second, second + " end")]
    assert got == sorted(alone + [(1, first), (8, third), (7, ""), (7, None), (7, None), (None, " ")], key=str)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(d).collect() == []
    assert one_per_component(d).collect() == []


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(None, 3), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_family_pairs_meet_by_what_they_gain(spark, monkeypatch):
    """Copies that all replace some passage of a centre: many lack the same, only twos share what is new."""
    met = []
    real = jaccard._meetings
    monkeypatch.setattr(jaccard, "_meetings", lambda *a: met.append(real(*a).count()) or real(*a))
    rng = random.Random(4)
    rows, sets = [], {}
    for node in range(600):
        linked = node < 300  # similar to the centre, so of its component
        at, n = (rng.randrange(100), 5) if linked else (node // 2 * 7 + rng.randrange(4), rng.choice([12, 13, 14]))
        lost = {(at + k) % 100 for k in range(n)}
        gained = [1000 * (node if linked else 300 + node // 2) + 500 + k for k in range(n)]
        sets[node] = set(range(100)) - lost | set(gained)
        rows.append((0, 100, node, 100, -1 if linked else node, 100 - n, gained, sorted(lost)))
    shape = "fam long, na long, node long, n long, comp long, inside long, gained array<long>, lost array<long>"
    got = [frozenset((r.x, r.y)) for r in jaccard._family_pairs(spark.createDataFrame(rows, shape), 80).collect()]
    similar = {frozenset((x, y)) for x in range(300, 600) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert similar and similar <= set(got)
    assert len(got) == len(set(got))
    assert sum(met) < 5 * len(rows), met


def test_shortened_copies(spark, monkeypatch):
    """Copies with words cut out and few new ones, so that pairs can be similar by what they have of the centre alone."""
    monkeypatch.setattr(jaccard, "BANDS", 2)
    rng = random.Random(13)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(300):
        at, n = rng.randrange(150), rng.choice([0, 3, 10, 20, 28, 34])
        words = base[:at] + base[at + n :]
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def _work(spark, run):
    """Jobs and tasks of a run, as Spark's tracker tells them: the driver holds a record of each."""
    context = spark.sparkContext

    def last():
        context.setJobGroup(group := f"mark-{random.random()}", "")
        context.parallelize([1], 1).count()
        return max(context.statusTracker().getJobIdsForGroup(group))

    first = last()
    run()
    jobs = range(first + 1, last())
    stages = {s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds}
    return len(jobs), sum(i.numTasks for s in stages if (i := context.statusTracker().getStageInfo(s)))


def test_few_jobs_and_tasks_for_few_links(spark):
    """What the driver keeps of jobs and tasks grows with their number, however few the rows are."""
    rows = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    links = rows.join(spark.createDataFrame([(k,) for k in range(40)], "a long"), "a")
    jobs, tasks = _work(spark, lambda: components(links).collect())
    assert jobs <= 48 and tasks <= 100, (jobs, tasks)
