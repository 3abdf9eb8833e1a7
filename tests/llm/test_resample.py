"""Importance resampling against a count by hand."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from auditloom.llm import op11_resample as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHING = "doc_id long, text string, bucket long, n long, weight string, score long, position long, short string"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def by_hand(docs, target, least=20, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, int).tolist(), np.zeros(10000, int).tolist()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        words, found = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) < least))
    ranks = {}
    able = sorted((k for k in range(len(rows)) if not rows[k][4]), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    for rank, k in enumerate(able[: percent * len(able) // 100], 1):
        ranks[k] = rank
    return [(*r[:4], ranks.get(k)) for k, r in enumerate(rows)]


def sample(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA9", "ß", "été", "x", "7", "数据", "delta" * 20, "o" * 200, "İ", "K"]
    glue = [" ", ", ", "\n", "--", "\x7f", "'"]
    out = ["".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*out, None, "", "...", out[0], out[0], "one", "one two", "one two three"]


@pytest.mark.parametrize("sizes", [{}, {"most_nodes": 50, "slice_bytes": 300}])
def test_resample(spark, sizes):
    docs = [(None if i == 40 else i // 2 * 2 if i > 80 else i, t) for i, t in enumerate(sample(120))]
    target = sample(15, seed=2)
    rows = spark.createDataFrame([(i, t, 1, 2, "w", 3, 4, "s") for i, t in docs], CLASHING).repartition(3)
    got = op.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, **sizes)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {d for _, d in got.dtypes} == {"bigint"}
    wanted = by_hand(docs, target, percent=30)
    got = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, [r[:4] for r in got])) == sorted(map(repr, [r[:4] for r in wanted]))
    drawn = lambda rows: sorted((r[4], r[3], r[0] is None, r[0] or 0) for r in rows if r[4] is not None)
    assert drawn(got) == drawn(wanted) and drawn(wanted)


@pytest.mark.parametrize("most", [40, 1000, 1 << 20])
def test_parts_of_a_long_text_give_what_the_whole_gives(most):
    import pyarrow as pa

    text = " ".join(x or "" for x in sample(200, seed=3)) * 3
    trie = op.WordTrie(10000)
    words, n, _ = op._walk(trie, pa.array([text]), most)
    trie.flush()
    spelt, found = features(text)
    wanted = np.bincount([zlib.crc32(f.encode()) % 10000 for f in found], minlength=10000)
    assert (words[0], n[0]) == (len(spelt), len(found)) and np.array_equal(trie.totals, wanted)


def test_drawn_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(sample(60))], "doc_id long, text string")
    ranks = op.resample(docs, docs.limit(5), percent=50)
    assert op.drawn_documents(docs, ranks).count() == ranks.filter("rank is not null").count() > 0


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.resample(none, none).collect() == []
