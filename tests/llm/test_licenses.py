import random
import re

from wardline.llm.licenses import LICENSES, collision_probability, license_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(docs, templates):
    out = {}
    for doc, text in docs:
        w = WORD.findall((text or "").lower())
        for name, t in templates:
            tw = WORD.findall((t or "").lower())
            if len(tw) < 5 or name is None:
                continue
            width = 16
            while width < 2 * len(tw):
                width *= 2
            need = grams(tw)
            for k in range(0, len(w) // (width // 2) + 1):
                found = len(need & grams(w[k * width // 2 : k * width // 2 + width]))
                if 100 * found >= 80 * len(need):
                    old = out.get((doc, name), (len(need), 0, 0, k * width // 2))
                    out[doc, name] = (len(need), max(old[1], found), old[2] + 1, old[3])
    return out


def test_equal_to_brute_force(spark):
    rng = random.Random(12)
    filler = lambda n: " ".join(rng.choice("the of and to in is it on as at".split()) for _ in range(n))
    docs = []
    for k in range(200):
        name, text = rng.choice(LICENSES)
        words = text.split()
        if k % 3 == 0:  # a word changed
            words[rng.randrange(len(words))] = "changed"
        docs.append((k, filler(rng.randint(0, 60)) + "\n" + " ".join(words).upper() + "\n" + filler(rng.randint(0, 60))))
    docs += [(300, None), (301, ""), (302, "Licensed under the"), (303, " ".join(t for _, t in LICENSES) * 2), (None, LICENSES[0][1]), (1, docs[1][1])]
    docs += [(304, (LICENSES[4][1] + " ") * 2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    t = spark.createDataFrame([*LICENSES, ("short", "only four words here"), ("none", None), (None, "a template without any name"), LICENSES[3]], "name string, text string")
    got = {(r.doc_id, r.template): (r.n_shingles, r.most_matched, r.n_windows, r.first_word) for r in license_matches(d, t).collect()}
    assert got == brute([x for x in docs if x[0] != 1] + [docs[1]], LICENSES)


def test_blocks_and_empty(spark, monkeypatch):
    import wardline.llm.licenses as module

    d = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(LICENSES)], "doc_id long, text string")
    t = spark.createDataFrame(LICENSES, "name string, text string")
    whole = sorted(map(tuple, license_matches(d, t).collect()))
    monkeypatch.setattr(module, "BLOCK_SHINGLES", 12)
    assert sorted(map(tuple, license_matches(d, t).collect())) == whole
    assert len(whole) >= len(LICENSES)
    assert license_matches(d.filter("false"), t).collect() == []
    assert license_matches(d, t.filter("false")).collect() == []


def test_bands_guarantee():
    assert collision_probability(1 / 12) > 0.999
    assert collision_probability(0.8) > 1 - 1e-12
