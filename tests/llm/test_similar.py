"""Near-duplicates by shingle similarity against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from auditloom.llm import op3_similar


def grams(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(x: frozenset, y: frozenset) -> bool:
    return x == y or len(x & y) >= 0.8 * len(x | y)


def roots(sets: list[frozenset]) -> list[int]:
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("cap", [4096, 6])
def test_similar(spark, cap):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randint(0, 900)}" for _ in range(n)]
    base = [say(300) for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:
        for changes in (1, 2, 3, 9, 30):
            copy = list(b)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    texts += [" ".join([*base[0][:-1], f"end{i}"]) for i in range(20)]
    texts += [texts[3], texts[3].upper(), "", None, " \t", "one", "One", "two words", "x " * 3000, "y " * 3000]
    sets = [grams(t) for t in texts]
    root = roots(sets)
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(texts)], "doc_id long, text string, node int, root string")
    out = op3_similar.drop_similar(docs, cap=cap)
    assert out.schema == docs.schema
    assert {r.doc_id for r in out.collect()} == set(root)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (None, None), (None, "")], "doc_id long, text string")
    kept = [tuple(r) for r in op3_similar.drop_similar(docs).collect()]
    assert len(kept) == 2 and (5, "a b") in kept and next(k for k in kept if k[0] is None)[1] in (None, "")
    assert op3_similar.drop_similar(docs.limit(0)).count() == 0


def test_wide_fingerprints_take_the_majority():
    sets = [np.arange(n, dtype=np.uint64) * np.uint64(97) for n in (3, 0, 1, 255, 256, 1000)]
    w = op3_similar.wide_fingerprints(sets, 2)
    for i, one in enumerate(sets):
        for k in range(2):
            h = [int(x) for x in op3_similar._mixed(one, k)]
            assert int(w[i, k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def family(rng: random.Random, mates: int, pairs: int) -> list[str]:
    """Texts of 200 shingles with a similarity of 0.74 to each other, of which some have a copy at 0.82."""
    base = [f"w{rng.randint(0, 9999)}" for _ in range(204)]

    def changed(words: list[str], places: list[int], tag: str) -> list[str]:
        words = list(words)
        for p in places:
            words[p] = f"{tag}n{p}"
        return words

    out = []
    for m in range(mates):
        places = rng.sample(range(8, 196, 6), 7)
        one = changed(base, places[:3], f"a{m}")
        out.append(" ".join(one))
        if m < pairs:
            out.append(" ".join(changed(one, places[3:], f"b{m}")))
    return out


@pytest.mark.parametrize("cap", [4096, 200])
def test_pairs_within_a_family_of_lesser_similarity(spark, cap):
    texts = family(random.Random(7), 360, 40)
    root = roots([grams(t) for t in texts])
    assert len(texts) - len(set(root)) >= 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in op3_similar.drop_similar(docs, cap=cap).collect()} == set(root)


def test_short_texts_at_the_least_similarity(spark):
    words = [f"w{i}" for i in range(60 * 9)]
    texts = []
    for i in range(60):
        one = words[9 * i : 9 * i + 9]
        texts += [" ".join(one), " ".join(one[:8])]  # five shingles and four of them
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in op3_similar.drop_similar(docs).collect()) == list(range(0, 120, 2))
