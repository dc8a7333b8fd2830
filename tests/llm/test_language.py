"""Language by compression: held-out accuracy in every language, odd texts, rejection."""

import random
from pathlib import Path

import pyarrow as pa
import pytest

from wardline.llm import language
from wardline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"
WORDS = {
    "de": "der die und ist nicht ein eine Haus Straße schön über gehen Wasser Kinder heute Fenster".split(),
    "en": "the and is not a house street nice over going water children today window with this".split(),
    "el": "και το είναι δεν ένα σπίτι δρόμος ωραίο πάνω νερό παιδιά σήμερα παράθυρο με αυτό".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(n=120):
    rng = random.Random(3)
    return [(k, prose(rng, lang, rng.randint(4, 200)), lang) for k, lang in enumerate(rng.choices(list(WORDS), [1, 5, 1], k=n))]


@pytest.fixture(scope="module")
def model(spark):
    return language.train_on(spark.createDataFrame(corpus(), SCHEMA))


def test_new_texts(spark, model):
    rng = random.Random(4)
    rows = [(k, prose(rng, lang, 12), lang) for k, lang in enumerate(list(WORDS) * 20)]
    found = language.languages_of(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(found) == len(rows) and all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in found)
    assert not any(r["rejected"] for r in found)


def test_odd_texts(spark, model):
    rng = random.Random(5)
    long = prose(rng, "de", 300_000)
    rows = [(0, None, "a"), (1, "", "a"), (2, " 12 !? \n", "a"), (3, long, "a"), (4, "Q", None), (4, "Q", None), (5, "x" * 10_000, "b")]
    found = {r["doc_id"]: r for r in language.languages_of(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert len(long) > 1 << 20 and found[3]["lang_pred"] == "de"
    for k in (0, 1, 2):
        assert (found[k]["lang_pred"], found[k]["score"], found[k]["rejected"]) == ("und", 0.0, True)
    assert found[4]["lang_pred"] == "en" and found[4]["rejected"]  # a tie goes to the most common language
    assert found[5]["lang_pred"] in WORDS


def test_rejected_answers_can_be_withheld(spark, model):
    rows = spark.createDataFrame([(1, "Q", "x"), (2, "the house is not nice today and this street", "x")], SCHEMA)
    found = language.languages_of(rows, model, carry=["doc_id"], reject=True).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found] == ["und", "en"]


def test_clashing_columns(spark, model):
    rows = spark.createDataFrame([(1, "the house", 2.0, "z", 1, 1, "k")], "doc_id long, text string, score double, lang_pred string, margin int, row int, `a.b` string")
    (row,) = language.languages_of(rows, model).collect()
    assert row["lang_pred"] == "en" and row["row"] == 1 and row["a.b"] == "k"


def test_hot_copies_and_rare_languages(spark):
    """A text that makes up most rows of a language does not crowd out the others; one row is enough for a language."""
    rng = random.Random(6)
    rows = [(1, "zzz yyy", "en")] * 3000 + [(k, prose(rng, "en", 50), "en") for k in range(50)] + [(9, prose(rng, "el", 50), "el")]
    model = language.train_on(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["en", "el"]
    assert model.contents[0].count(b"zzz") == 1 and len(model.contents[0]) > 5000
    scorer = model.scorer()
    assert scorer.answer(language.plain(pa.array([prose(rng, "el", 10)]))[0])[0] == "el"


def test_no_labels_and_one_language(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.languages_of(empty, language.train_on(empty)).collect() == []
    none = language.train_on(spark.createDataFrame([(1, "text", None), (2, None, "en")], SCHEMA))
    one = language.train_on(spark.createDataFrame([(1, "some text", "en")], SCHEMA))
    docs = spark.createDataFrame([(1, "text", None)], SCHEMA)
    assert language.languages_of(docs, none).first()["lang_pred"] == "und"
    found = language.languages_of(docs, one).first()
    assert (found["lang_pred"], found["score"]) == ("en", 1.0)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_held_out_accuracy_in_every_language(spark, scale):
    folder = Path("/root/testdata") / scale
    if not folder.exists():
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(str(folder / "documents.parquet")).select("doc_id", "lang", "n_chars")
    found = QUERIES["op11_language"](spark, str(folder))
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    found = found.join(docs, "doc_id").toPandas()
    assert len(found) == docs.count()
    found = found[found["held_out"]]
    for lang, part in found.groupby("lang"):
        assert (part["lang_pred"] == lang).mean() >= 0.95, lang
    sure = found[~found["rejected"]]
    assert (sure["lang_pred"] == sure["lang"]).mean() >= 0.995
