"""The pipeline on a small corpus with planted cases."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from auditloom.llm._store import save


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["thon", "ering", "wham", "and", "over", "ten", "lim", "dra", "uno", "best"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    clean = [say(150) for _ in range(40)]
    passage = say(60)
    texts = [*clean, clean[0], clean[0], clean[1] + " added", "%%% 000 ###", "", None, say(90) + " mail to a.b@c.de now", say(80) + passage + say(40), say(70) + passage]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, texts, passage


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    language, near, repeated, private = seen
    assert set(language) == set(range(len(texts))) - {43, 44, 45}
    assert set(range(2, 40)) | {0} <= set(near) and not {40, 41} & set(near) and len({1, 42} & set(near)) == 1
    assert set(repeated) == set(near) == set(private) and {46, 47, 48} <= set(near)
    assert passage not in repeated[47] and passage not in repeated[48] and repeated[20] == texts[20]
    assert not any("a.b@c.de" in (t or "") for t in private.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == set(private)


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
    assert len(corpus_pipeline.STAGES) == 5
