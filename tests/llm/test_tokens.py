"""SentencePiece encoding and decoding against the library and by exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from docframe.llm import tokenising
from docframe.llm.pieces import MARK, Vocabulary, times
from docframe.llm.tokenising import MODEL, encode, read_model, with_tokens
from tests.llm.conftest import SF, odd_documents


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_model(MODEL))


def strange_texts():
    rng = random.Random(2)
    alphabets = ["ab", "the in on ", "éñß中文 ", "  \n\ta", "0123456789 .,", "\U0001f600x \x00", "▁ a▁"]
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 120))) for a in alphabets for _ in range(40)]


def test_whole_texts_match_the_library(library, vocabulary, sample_rows):
    for text in [t for _, t in sample_rows[:60]] + strange_texts():
        assert np.frombuffer(vocabulary.encode(text), "<i4").tolist() == library.encode(text), text[:80]


def unspaced_texts():
    rng = random.Random(9)
    chinese = "".join(map(chr, range(0x4E00, 0x4E00 + 900)))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    thai, faces = "".join(map(chr, range(0x0E01, 0x0E2F))), "".join(map(chr, range(0x1F600, 0x1F640)))
    return ["".join(rng.choice(a) for _ in range(n)) for a in ("0123456789", chinese, base64, thai, faces) for n in (6000, 40_000)]


def test_unspaced_runs_match_the_library(spark, library, vocabulary):
    texts = unspaced_texts()
    assert all(np.frombuffer(vocabulary.encode(t), "<i4").tolist() == library.encode(t) for t in texts)
    got = {r["doc_id"]: r["ids"] for r in with_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, 0.0, -np.inf) for _ in range(3))
    assert (times(times(a, b), c) == times(a, times(b, c))).all()


@pytest.mark.parametrize("chunk", [129, 200])
def test_chunks_give_the_same_pieces(spark, library, chunk):
    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("abcdefghij ", "the", " ", "中ab", "theinon▁ ") for n in (130, 257, 900, 1500)]
    df = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "doc_key binary, text string")
    got = {int(r["doc_key"]): r["ids"] for r in encode(df, chunk=chunk).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def test_round_trip(spark, odd, library):
    got = {r["doc_id"]: r for r in with_tokens(odd, chunk=2000).collect()}
    for d, t, *_ in odd_documents():
        ids = library.encode(t or "")
        assert got[d]["ids"] == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").replace(MARK, " ").encode()).hexdigest()


def test_real_documents_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = with_tokens(docs, chunk=4096).join(docs, "doc_id")
    assert both.where("decoded_sha256 != sha2(text, 256)").count() == 0 and both.count() == docs.count()


def test_empty_table(empty):
    assert with_tokens(empty).count() == 0


def test_what_is_remembered_is_bounded(library):
    small = Vocabulary(read_model(MODEL), remember=50, memory=20_000)
    texts = [" ".join(f"word{i * k}" for i in range(60)) + "\n" * (k % 3) + "next" for k in range(40)]
    assert all(np.frombuffer(small.encode(t), "<i4").tolist() == library.encode(t) for t in texts)
    assert len(small.words) + len(small.older) < 200 and len(small.units) <= 50


def test_a_deep_tree_of_products(spark, library, monkeypatch):
    monkeypatch.setattr(tokenising, "FAN", 3)
    rng = random.Random(8)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("abcdefghij ", "中ab", "theinon▁ ", "  a") for n in (5000, 1300)]
    df = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "doc_key binary, text string")
    got = {int(r["doc_key"]): r["ids"] for r in encode(df, chunk=150).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def test_repeated_giants_null_ids_and_clashing_columns(spark, library):
    text = " ".join(f"w{i}" for i in range(3000))
    rows_in = [(None, text, b"x", 1), (7, text, b"y", 2), (7, text, b"y", 2), (8, None, None, None), (None, "", b"z", 0)]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, doc_key binary, chunk int")
    got = with_tokens(docs, chunk=1000).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((d is None, d or 0, len(library.encode(t or ""))) for d, t, *_ in rows_in)
    assert sum(r["ids"] == library.encode(text) for r in got) == 3
