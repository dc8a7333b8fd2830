import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from wardline.llm.toxicity import plain, toxicity_scores, train, train_on, windows

LARGER = Path("/root/testdata/sf0.1")


def corpus(rng, n):
    parts = ["ka", "to", "mi", "ren", "sol", "ba", "den", "ur", "lis", "po"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    out = []
    for k in range(n):
        toxic = k % 5 == 0
        words = [word() for _ in range(rng.randint(30, 150))]
        if toxic:
            for _ in range(1 + len(words) // 25):
                words[rng.randrange(len(words))] = rng.choice(["gruntheap", "vilewort", "skunkface", "blightbag"])
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_windows_cover_the_whole_text():
    text = plain("Some WORDS, and more! " * 40)
    assert text.startswith(b" some words and more some")
    parts = windows(text)
    whole = bytearray(len(text))
    for k, p in enumerate(parts):
        whole[64 * k : 64 * k + len(p)] = p
    assert bytes(whole) == text
    assert windows(b"") == [] and plain(None) == plain("12 !") == b""


def test_separates(spark):
    rows = corpus(random.Random(1), 1500)
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = d.filter("doc_id % 3 <> 0").select("doc_id", "toxic")
    model = train_on(d.select("doc_id", "text"), labels.unionAll(spark.createDataFrame([(None, 1), (4, None)], "doc_id long, toxic int")))
    scored = toxicity_scores(d.withColumn("score", F.lit("old")), model)
    assert scored.columns == ["doc_id", "text", "toxic", "score"]
    got = [r for r in scored.collect() if r.doc_id % 3 == 0]
    assert len(got) == 500
    hit = [r.score >= 0.3 for r in got if r.toxic]
    false = [r.score >= 0.3 for r in got if not r.toxic]
    assert sum(hit) >= 0.9 * len(hit) and sum(false) <= 0.05 * len(false)


def test_cases(spark):
    rows = corpus(random.Random(2), 300)
    model = train([t for _, t, y in rows if y], [t for _, t, y in rows if not y], 0.2)
    d = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "ka to"), (4, "ka to mi " * 100_000), (4, "ka to mi " * 100_000)], "doc_id long, text string")
    got = toxicity_scores(d, model, carry=["doc_id"]).collect()
    assert len(got) == 6
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0.0] * 3
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert toxicity_scores(d.filter("false"), model).collect() == []


def test_few_or_no_labels(spark):
    for toxic, ordinary in ((["bad words here"], []), ([], ["some fine words"]), ([], []), (["one"], ["two"])):
        assert 0 <= train(toxic, ordinary, 0.1).scorer().score("some words here") <= 1
    d = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity_scores(d, train_on(d, none)).count() == 1


@pytest.mark.skipif(not LARGER.exists(), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    got = contract.queries()["op7_toxicity"](spark, str(LARGER))
    labels = spark.read.parquet(str(LARGER / "labels.parquet"))
    # few labelled toxic documents there are in other languages
    english = spark.read.parquet(str(LARGER / "documents.parquet")).filter("lang = 'en'").select("doc_id")
    rows = got.filter("held_out").join(labels, "doc_id").join(english, "doc_id").select("score", "predicted", "toxic").collect()
    toxic = [r for r in rows if r.toxic]
    fine = [r for r in rows if not r.toxic]
    recall = sum(r.predicted for r in toxic) / len(toxic)
    wrong = sum(r.predicted for r in fine) / len(fine)
    above = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in fine) / (len(toxic) * len(fine))
    assert recall > 0.8 and wrong < 0.03 and above > 0.95


@pytest.mark.skipif(not LARGER.exists(), reason="driver tables are not here")
def test_held_out_accuracy_in_every_language(spark):
    got = contract.queries()["op7_toxicity"](spark, str(LARGER))
    labels = spark.read.parquet(str(LARGER / "labels.parquet"))
    docs = spark.read.parquet(str(LARGER / "documents.parquet")).select("doc_id", "lang")
    rows = got.filter("held_out").join(labels, "doc_id").join(docs, "doc_id").select("lang", "predicted", "toxic").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.predicted for r in rows if r.lang == lang and r.toxic]
        fine = [r.predicted for r in rows if r.lang == lang and not r.toxic]
        assert sum(toxic) >= 0.5 * len(toxic) and sum(fine) <= 0.1 * len(fine), lang
