"""Cases at the edges of what operators hold at a time, and ids and columns that clash."""

from __future__ import annotations

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_text_operators import repeats

from auditloom.llm import op5_langid, op7_packing, op8_ann, op10_suffix
from auditloom.llm.queries import BYTE_BPE, tokenizer_file

BPE = tokenizer_file(BYTE_BPE)


@pytest.mark.skipif(not os.path.exists(BPE), reason="no tokenizer files")
def test_packing_takes_null_and_repeated_ids_clashing_columns_and_texts_over_a_slice(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op7_packing, "SLICE", 2000)
    rng, tokenizer = random.Random(1), Tokenizer.from_file(BPE)
    texts = [" ".join(rng.choice(["ab.", "cd", "ef!"]) for _ in range(n)) for n in (5, 900, 40, 1, 4000, 300)]
    rows = [(i, t, 1, 2, "x") for i, t in zip((7, 7, None, None, 1, 7), texts, strict=True)]
    got = op7_packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, start long, sequence_id long, i string").coalesce(1), BPE).collect()
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4"))
    # Pieces of a task come in the order of its rows.
    for i, wanted in ids.items():
        pieces = sorted((p for p in got if p.doc_id == i), key=lambda p: (p.sequence_id, p.offset))
        for w in wanted:
            at = 0
            while at < len(w):
                p = pieces.pop(0)
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(w), zlib.crc32(w[at : at + p.length].tobytes()))
                at += p.length
        assert not pieces


def test_languages_of_texts_over_a_slice(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda parts, n: " ".join(rng.choice(parts) + rng.choice(parts) for _ in range(n))
    one, two = ["thon", "ering", "wham"], ["zück", "lich", "öft"]
    rows = [(i, say(one if i % 2 else two, n), "aa" if i % 2 else "bb", "s") for i, n in enumerate([20] * 60 + [3000, 3000, 1])] + [(100, "%% 12", None, "s"), (101, None, "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = op5_langid.fit(docs)
    wanted = sorted(r.doc_id for r in op5_langid.filter_documents(docs, whole, declared_col=None).collect())
    monkeypatch.setattr(op5_langid, "SLICE", 500)
    parts = op5_langid.fit(docs)
    assert np.array_equal(whole.log, parts.log)
    assert sorted(r.doc_id for r in op5_langid.filter_documents(docs, parts, declared_col=None).collect()) == wanted == list(range(63))


def test_repeats_in_texts_over_a_slice(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    say = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    texts = [say(9000) + passage + say(4000), say(300) + passage, say(2000), say(100) + passage + say(7000) + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(map(tuple, op10_suffix.repeat_digests(docs).collect()))
    monkeypatch.setattr(op10_suffix, "SLICE", 512)
    assert sorted(map(tuple, op10_suffix.repeat_digests(docs).collect())) == whole
    assert [r[1:] for r in whole] == repeats(texts, 200) and whole[0][2] >= 260 and whole[3][2] >= 520


def test_a_query_id_that_comes_twice(spark):
    """Both vectors ask, and what either finds is ranked together."""
    x = np.random.default_rng(4).standard_normal((60, 8))
    data = [(i, v) for i, v in enumerate(x.tolist())] + [(20, (-x[20]).tolist())]
    got = sorted((r.rank, r.vec_id, round(r.score, 9)) for r in op8_ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 20, k=10).collect() if r.query_id == 20)
    scores = np.maximum(x @ x[20], -(x @ x[20]))
    wanted = sorted((-round(float(s), 9), i) for i, s in enumerate(scores) if i != 20)[:10]
    assert got == [(rank, i, -s) for rank, (s, i) in enumerate(wanted, 1)]
