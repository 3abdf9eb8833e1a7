"""Byte-level BPE over chunks against the library, text by text."""

from __future__ import annotations

import hashlib
import os
import random
import struct

import numpy as np
import pytest

from auditloom.llm import op12_bpe
from auditloom.llm.queries import RANKS, tokenizer_file

PATH = tokenizer_file(RANKS)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
CLASHING = "doc_id long, text string, row long, k long, part string, last string, ids string"
PIECES = ["a", "é", "1", " ", "  ", "\n", "'s", "'re", "'", "!", "?!", " ", " ", "汉", "🙂", "՘", "\u0085", "\x1c", "word", "²", "\t", "'ll", "don't"]


@pytest.fixture(scope="module")
def words():
    return op12_bpe.RankEncoder(PATH)


def texts():
    rng = random.Random(4)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    return [*out, None, "", out[0], out[0], "a" * 5000, " " * 5000 + "x", "'" * 3000, ("word " * 2000)[:-1], "b" * 700 + "  " + "c" * 900, "\n" * 300 + "é" * 2000, "<|endoftext|> plain"]


def wanted(words, text):
    ids = words.library.encode_ordinary(text or "")
    assert words.library.decode_bytes(ids) == (text or "").encode()
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (40, 24), (64, 16), (300, 50), (1 << 16, 1 << 10)])
def test_stitched_words_equal_those_of_the_whole_text(words, chunk, overlap):
    for text in filter(None, texts()):
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        assert op12_bpe._word_starts(words, data, offsets, chunk, overlap).tolist() == words.words(data, offsets).tolist()


def test_ids_equal_the_library(words):
    for text in filter(None, texts()):
        data = np.frombuffer(text.encode(), np.uint8)
        assert words.ids_of(data, op12_bpe._word_starts(words, data, np.array([0, len(data)]), 64, 16))[0].tolist() == words.library.encode_ordinary(text)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 64, "overlap": 16, "long_bytes": 300}])
def test_digests(spark, words, sizes):
    rows = [(None if i % 9 == 8 else i // 2, t, 1, 2, "p", "l", "i") for i, t in enumerate(texts())]
    got = op12_bpe.codec_digests(spark.createDataFrame(rows, CLASHING).repartition(3), PATH, **sizes).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *wanted(words, r[1]))) for r in rows)


@pytest.mark.parametrize("long_bytes", [200, 1 << 20])
def test_encode_and_decode(spark, words, long_bytes):
    rows = [(i, t) for i, t in enumerate(texts())]
    encoded = op12_bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, chunk=64, overlap=16, long_bytes=long_bytes)
    got: dict = {}
    for r in sorted(op12_bpe.decode(encoded, PATH).collect(), key=lambda r: r.piece):
        ids, raw = got.get(r.doc_id, ([], b""))
        got[r.doc_id] = ids + list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)), raw + bytes(r.bytes)
    assert got == {i: (words.library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}


def test_a_run_over_many_chunks_stays_linear(words):
    data = np.frombuffer(("x" * 8_000_000 + " end").encode(), np.uint8)
    assert len(op12_bpe._word_starts(words, data, np.array([0, len(data)]), 1 << 12, 1 << 8)) == 2


def test_no_rows(spark):
    assert op12_bpe.codec_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
