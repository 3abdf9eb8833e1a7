"""Line patches against applying them, and exact token counts against the libraries."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom.operators import diff, patch, tokens
from auditloom.plans import catalog
from auditloom.sources.vocabulary import tokenizer_file

FOLDER = "/root/testdata/sf0.001"


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randint(0, 6)):
        at = rng.randint(0, len(out))
        if rng.random() < 0.5 and out:
            del out[at : at + rng.randint(1, 3)]
        else:
            out[at:at] = [rng.choice("abcdef") for _ in range(rng.randint(1, 3))]
    return out


def shortest(a, b):
    """Least number of deleted and added lines."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_patches_make_the_second_version_of_the_first(spark):
    rng, rows = random.Random(3), []
    for _ in range(1500):
        a = [rng.choice("abcdefgh") + rng.choice(["", "", str(rng.randint(0, 30))]) for _ in range(rng.randint(0, 30))]
        b = edited(rng, a)
        rows.append(("\n".join(a) + rng.choice(["", "\n"]), "\n".join(b) + rng.choice(["", "\n"])))
    rows += [("", "x"), ("x", ""), (None, "a\nb\n"), ("a\nb", None), (None, None), ("a b\r\nc\x0b", "a b\r\nd\x0b"), ("\n\n\n", "\n")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, before string, after string")
    made = df.withColumn("patch", patch.patch_column(F.lit("p"), F.col("before"), F.col("after"))).withColumn("got", patch.patched_column(F.col("before"), F.col("patch")))
    got = {r.i: r for r in made.collect()}
    for i, (_, after) in enumerate(rows):
        assert got[i].got == (None if got[i].patch is None else after or "")
    least = [(len(a) + len(b) - 2 * len(patch.matches(a, b)), shortest(a, b)) for a, b in ((patch.lines_of(a or ""), patch.lines_of(b or "")) for a, b in rows)]
    assert all(x >= y for x, y in least) and sum(x for x, _ in least) <= 1.1 * sum(y for _, y in least)
    counted = made.select("i", *(c.alias(n) for c, n in zip(diff.line_counts(F.col("patch")), ("plus", "minus"), strict=True))).filter("plus IS NOT NULL").collect()
    assert all(r.plus + r.minus == least[r.i][0] for r in counted)


def test_form_of_a_patch():
    a, b = "".join(f"{i}\n" for i in range(1, 21)), "".join(f"{i}\n" for i in range(1, 21) if i != 3).replace("15\n", "15!\n").removesuffix("\n")
    assert patch.unified("x.py", a, b) == "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,5 +1,4 @@\n 1\n 2\n-3\n 4\n 5\n@@ -13,8 +12,8 @@\n 13\n 14\n-15\n+15!\n 16\n 17\n 18\n 19\n-20\n+20\n\\ No newline at end of file\n"
    assert patch.unified("n", None, "a\n").split("\n")[1:4] == ["--- /dev/null", "+++ b/n", "@@ -0,0 +1,1 @@"]
    with pytest.raises(ValueError, match="isn't"):
        patch.apply("other\n", patch.unified("x", "one\n", "two\n"))
    assert patch.apply("a\nb\nc\n", "@@ -2 +2 @@\n-b\n+B\n") == "a\nB\nc\n"


def test_stretches_that_are_too_costly_are_replaced(monkeypatch):
    monkeypatch.setattr(patch, "MOST_EDITS", 5)
    a, b = "".join(random.Random(1).choices("xy\n", k=900)), "".join(random.Random(2).choices("xy\n", k=900))
    assert patch.apply(a, patch.unified("p", a, b)) == b


def test_patches_of_a_batch_leave_in_slices(spark, monkeypatch):
    made = []
    rows = pa.array([str(i) for i in range(50)] + [None])
    parts = patch.sliced(lambda t: made.append(t) or (t and t * (patch.SLICE // 4)), iter([(rows,), (rows.slice(0, 0),), (rows.slice(50),)]))
    assert 1 <= len(next(parts)) == len(made) < 6
    assert sum(map(len, parts)) + 4 == len(made) == 52
    df = spark.range(300).selectExpr("id", "repeat(concat(id, '\n'), 3000) AS before", "repeat(concat(id, '!\n'), 3000) AS after").coalesce(1)
    p = patch.patch_column(F.lit("p"), F.col("before"), F.col("after"))
    got = df.withColumn("patch", p).select("id", F.col("after") == patch.patched_column(F.col("before"), F.col("patch")), F.col("patch").startswith("diff"))
    assert [tuple(r) for r in got.collect()] == [(i, True, True) for i in range(300)]


def test_a_count_does_not_walk_the_words_known():
    """Work follows a text's own words, however many others were met before."""
    import public_tokenizers

    class Known(dict):
        def keys(self):
            raise AssertionError("all known words were walked")

        __iter__ = items = values = keys

    count = tokens.RankCounter(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count._sizes = Known()
    assert count(["one two three two", "two four"]) == [4, 2]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_exact_tokens_of_all_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r.tokens for r in catalog.QUERIES["exact_tokens"](spark, FOLDER).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False)) for i, t in texts.items()}


def test_merges_of_odd_words():
    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens._ranks(path), special_tokens={})
    rng, count = random.Random(5), tokens.RankCounter(path, public_tokenizers.PATTERN, most_words=10)
    texts = ["", "a" * 30_000, " ".join("".join(rng.choice("abeé汉🙂ß") for _ in range(rng.randint(1, 40))) for _ in range(300)), "'s don't\n\n  x", "!?" * 5000]
    assert count(texts) == [len(library.encode_ordinary(t)) for t in texts]
    for text in texts[1:3]:
        assert b"".join(tokens.merged(text.encode(), tokens._ranks(path))) == text.encode()


def test_a_gate_on_exact_tokens(spark):
    import public_tokenizers

    from auditloom.plans.review import token_gate

    count = tokens.RankCounter(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    row = token_gate(spark.createDataFrame([("one two three",), ("four",), (None,)], "content string"), "a prompt", override=10, count=count).first()
    assert (row.total, row.gate) == (6, "ok")
