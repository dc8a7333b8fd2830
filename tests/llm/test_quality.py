import random
import re
from collections import Counter

from wardline.llm.quality import quality_verdicts, rounded, text_statistics
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    counts = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(c.isupper() and len(c.upper()) for c in t), len(lines) - len(set(lines)), len(hit))


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t ", "one", "a b", "a b c a b c", "x " * 3, "\x0bé\x0c\r#|<>", "\n\n a\n a\na\n", "\x1ca\x85b c d"]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "B", "é", "🤖", " ", "  ", "\n", "#", "\t", "c "]) for _ in range(rng.randint(0, 200))))
    return out + ["p q r s " * 30_000]


def test_statistics(spark):
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (None, "no id")]
    d = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_words string")
    got = text_statistics(d.drop("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_dup_lines", "n_repeat_words"]
    assert sorted(((r.doc_id, *[r[n] for n in names]) for r in got.collect()), key=str) == sorted(((i, *expected(t)) for i, t in rows), key=str)


def test_rounded(spark):
    got = spark.range(5000).select("id", rounded(F.col("id")).alias("r")).collect()
    for r in got:
        drop = max(0, r.id.bit_length() - 7)
        assert r.r == (r.id >> drop) << drop


def test_limits_follow_groups(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    plain = lambda: " ".join(word() for _ in range(80))
    marked = lambda: " ".join(word() + rng.choice(["#", ""]) for _ in range(80))
    rows = [(k, plain(), "en", "news") for k in range(400)]
    rows += [(1000 + k, marked(), "en", "code") for k in range(300)]  # usual there
    rows += [(2000 + k, marked(), "en", "news") for k in range(20)]  # odd there
    rows += [(3000 + k, plain(), None, None) for k in range(5)] + [(4000, None, "en", "news"), (4001, "", "xx", "new")]
    rows += [(4002, "same thing again " * 40, "en", "news"), (4003, plain(), "xx", "new")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_verdicts(d.withColumn("kept", F.lit(1))).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == len(rows)
    assert kept == {i for i, _, _, s in rows if i < 2000 or 3000 <= i < 4000 or i == 4003}
    assert {tuple(r.failed) for r in got if 2000 <= r.doc_id < 3000} == {("symbols",)}
    assert [r.failed for r in got if r.doc_id == 4002] == [["base"]]


def test_small_odd_source_under_a_hot_one(spark):
    """Own quantiles count at every size: a source of symbol-rich texts keeps them, be it small or large."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    text = lambda odd: " ".join(word() + ("#" if odd and k % 2 else "") for k in range(120))
    for n in (40, 150, 199, 200, 260):
        rows = [(k, text(False), "en", "hot") for k in range(900)] + [(1000 + k, text(True), "en", "code") for k in range(n)]
        rows += [(5000 + k, text(True), "en", "hot") for k in range(5)]
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        kept = {r.doc_id for r in quality_verdicts(d).filter("kept").collect()}
        assert kept == {r[0] for r in rows if r[0] < 5000}, n


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "word " * 10, "a", "b", 1, 2, 3, 4, 5)], "doc_id long, text string, lang string, source string, _lang int, _source int, symbols_high int, b int, d int")
    (row,) = quality_verdicts(d).collect()
    assert (row["_lang"], row["_source"], row["symbols_high"], row["b"], row["d"], row["kept"]) == (1, 2, 3, 4, 5, False)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_verdicts(d).collect() == []
