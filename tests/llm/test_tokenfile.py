import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardline.llm.tokenfile import (
    TokenFile,
    TokenWriter,
    WordEncoder,
    bits_for,
    pack,
    read_token_files,
    unpack,
    write_token_files,
)

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_packing():
    rng = np.random.default_rng(0)
    for bits in (1, 3, 8, 13, 16, 17, 24, 32):
        for n in (0, 1, 7, 4096, 5001):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            data = pack(ids, bits)
            assert len(data) == (n * bits + 7) // 8
            assert (unpack(data, bits, n) == ids).all()
    assert [bits_for(v) for v in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 10_000).astype(np.uint32)
    ends = np.array([0, 5, 5, 4096, 9000, 10_000])
    for bits in (16, 17):
        out = io.BytesIO()
        writer = TokenWriter(out, bits, block=512)
        for k in range(0, 10_000, 700):
            writer.ids(ids[k : k + 700])
            assert len(writer.open) < 512
        writer.end(range(6), ends.tolist())
        writer.close()
        file = TokenFile(out)
        assert list(file.keys) == list(range(6))
        for k in range(6):
            assert (file.document(k) == ids[ends[k - 1] if k else 0 : ends[k]]).all()
        for _ in range(50):
            a, b = sorted(rng.integers(0, 10_001, 2))
            assert (file.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(b"x" * 100))
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(b""))


def test_words_encode_as_texts(tokenizer_json):
    tokenizer = Tokenizer.from_str(tokenizer_json)
    encoder = WordEncoder(tokenizer_json)

    def same(text):
        expected = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        for known in range(2):
            ids, ends = encoder.encode([text, text], 2)
            assert ids.tolist() == expected * 2 and ends.tolist() == [len(expected), 2 * len(expected)], text

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'́ sdtIİΣ<|>")), max_size=40))
    def run(text):
        same(text)

    run()
    for text in ("It's we'll  don't\n\n'd", "a <|endoftext|> b<|startoftext|>", "ΣΑΣ ς́ é ́x", "x" * 500, "", "<|ENDOFTEXT|> <|endoftext|>,"):
        same(text)


def test_store_stays_small_and_exact(tokenizer_json):
    rng = random.Random(3)
    tokenizer = Tokenizer.from_str(tokenizer_json)
    encoder = WordEncoder(tokenizer_json, store_bytes=4000)
    emptied = 0
    for _ in range(60):
        texts = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(40)) for _ in range(3)]
        before = len(encoder.store)
        ids, ends = encoder.encode(texts, 2)
        assert ids.tolist() == [x for t in texts for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]]
        assert encoder.store.bytes <= 4000
        emptied += len(encoder.store) < before
    assert emptied


def test_equal_hashes_are_told_apart(tokenizer_json, monkeypatch):
    from wardline.llm import tokenfile

    monkeypatch.setattr(tokenfile, "range_hashes", lambda data, a, b: (np.asarray(b - a) % 3).astype(np.uint64))
    tokenizer, encoder = Tokenizer.from_str(tokenizer_json), WordEncoder(tokenizer_json)
    for text in ("ab cd ef ab", "cd gh x y", "ab x hello world"):
        assert encoder.encode([text], 2)[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_long_text_in_pieces(tokenizer_json):
    tokenizer, encoder = Tokenizer.from_str(tokenizer_json), WordEncoder(tokenizer_json)
    text = "Höre, this is.  a\nlong one! " * 200 + "x" * 300 + " end"
    pieces = encoder.pieces(pa.array([text]), 100)
    assert len(pieces) > 20 and "".join(p[0].as_py() for p in pieces) == text
    found = np.concatenate([encoder.flat(p)[0] for p in pieces])
    assert found.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_hot_and_null_ids_span_files(spark, tokenizer_json, tmp_path):
    rows = [(7, f"hot text {k} " + "word " * 20) for k in range(300)] + [(None, "same row " * 10)] * 300 + [(k, "x") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = write_token_files(d, str(tmp_path / "out"), tokenizer_json, 49408, 2, file_bytes=4000)
    largest = files.agg({"n_docs": "max"}).first()[0]
    assert files.count() > 15 and largest < 200
    got = read_token_files(files).orderBy("start").collect()
    assert len(got) == 900 and [r.doc_id for r in got] == [None] * 300 + sorted(r[0] for r in rows if r[0] is not None)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("file_bytes", [1 << 20, 700])
def test_round_trip(spark, tokenizer_json, tmp_path, file_bytes):
    rng = random.Random(5)
    rows = [(k * 3 - 30, " ".join(rng.choice(["one", "Two", "thrée", "don't", "\n", "42"]) for _ in range(rng.randint(0, 30)))) for k in range(200)]
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (5000, "again"), (5000, "again"), (5000, "once"), (2000, "long word " * 3000)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, n_tokens int").repartition(5)
    tokenizer = Tokenizer.from_str(tokenizer_json)
    files = write_token_files(d, str(tmp_path / "out"), tokenizer_json, tokenizer.get_vocab_size(), 2, file_bytes=file_bytes)
    assert (files.count() > 3) == (file_bytes == 700)
    got = sorted(((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in read_token_files(files).collect()))
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [d for _, d, _, _ in got] == sorted(d for d, _ in rows)
    expected = sorted((d, len(ids(t)) // 4, zlib.crc32(ids(t))) for d, t in rows)
    assert sorted(x[1:] for x in got) == expected
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_null_id_and_empty(spark, tokenizer_json, tmp_path):
    d = spark.createDataFrame([(None, "no id"), (1, "x")], "doc_id long, text string")
    got = read_token_files(write_token_files(d, str(tmp_path / "a"), tokenizer_json, 49408, 2)).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (1, 3)]
    empty = write_token_files(d.filter("false"), str(tmp_path / "b"), tokenizer_json, 49408, 2)
    assert read_token_files(empty).collect() == []
