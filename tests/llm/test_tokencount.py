import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from wardline.llm.tokencount import SPACE, PieceCounter, piece_scores, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = [(f"<0x{k:02X}>", 0.0) for k in range(256)]
VOCABULARIES = {
    "ties": [("<unk>", 0.0)] + BYTES + [(p, -2.0) for p in ("a", "b", "ab", "ba", "aab", "bb", SPACE, SPACE + "a", SPACE + SPACE)] + [("abab", -4.0), ("aba", -4.0)],
    "no bytes": [("<unk>", 0.0), ("a", -3.0), ("ab", -5.0), ("b", -2.0), (SPACE, -1.0), ("b" + SPACE, -2.0)],
    "fractions": [("<unk>", 0.0)] + BYTES + [("a", -0.1), ("aa", -0.2), ("aaa", -0.30000000000000004), ("b", -0.7), (SPACE, -0.3), (SPACE + "b", -1.0)],
}


def library(pieces):
    byte = all(p in dict(pieces) for p, _ in BYTES)
    return Tokenizer(models.Unigram([(p, s) for p, s in pieces], 0, byte))


def expected(tokenizer, text):
    return len(tokenizer.encode(SPACE + text.replace(" ", SPACE), add_special_tokens=False).ids) if text else 0


@pytest.fixture(scope="module")
def public():
    return piece_scores(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("name", VOCABULARIES)
def test_same_as_library(name):
    pieces = VOCABULARIES[name]
    counter, tokenizer = PieceCounter(pieces), library(pieces)
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aaabb  éx\n") for _ in range(rng.randint(0, 25)))
        assert counter.count(text)[1] == expected(tokenizer, text), text


def test_same_as_library_public(public):
    counter, tokenizer = PieceCounter(public), library(public)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def run(text):
        assert counter.count(text)[1] == expected(tokenizer, text)

    run()
    for text in ("Hello  world,   again\n\nand <0x0A> <s> again", "日本語 текст ñandú 🤖🤖 x", "word " * 50):
        assert counter.count(text)[1] == expected(tokenizer, text)


def test_documents(spark, public):
    rows = [(1, "Some words here."), (1, "Some words here."), (2, None), (3, ""), (None, "x"), (4, "ab " * 200_000), (5, "z" * 30_000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens long")
    tokenizer = library(public)
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts(docs, public).collect()), key=str)
    assert got == sorted(((d, expected(tokenizer, t)) for d, t in rows), key=str)
    assert token_counts(docs.filter("false"), public).collect() == []
