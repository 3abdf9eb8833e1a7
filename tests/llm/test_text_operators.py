"""Operators on texts against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from auditloom.llm import op1_pii, op2_secrets, op3_simhash, op4_chat, op5_langid, op6_sentencepiece, op7_packing, op10_suffix
from auditloom.llm.queries import BYTE_BPE, PIECES, tokenizer_file

BPE, SPM = tokenizer_file(BYTE_BPE), tokenizer_file(PIECES)
needs_files = pytest.mark.skipif(not os.path.exists(BPE), reason="no tokenizer files")
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key string, t string, fp long"


def table(spark, texts):
    """Texts with null and repeated ids, and extra columns whose names clash with the operators' own."""
    rows = [(None if i % 9 == 8 else i // 2 * 2, t, "en", "s", 0, "k", "t", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(got, wanted):
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


# Personal data


def pii_base(text):
    out = []
    for kind in op1_pii.KINDS:
        for m in re.finditer(op1_pii.PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and op1_pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(0)
    for _ in range(5000):
        text = "".join(rng.choice("ab1@.@-.+ 4é0%_\n(") for _ in range(rng.randint(0, 40)))
        assert op1_pii.find_base(text) == pii_base(text), text
    cards = [d + c for d in ("411111111111111", "550000000000000") for c in "0123456789" if op1_pii.luhn(d + c)]
    for card in cards:
        for text in (card, " ".join(card), "1" + card, card + "-9", "9" * 30 + card):
            assert op1_pii.find_base(text) == pii_base(text), text
    assert op1_pii.find_base("1" * 50_000 + "@" * 50_000) == []
    assert op1_pii.find_base("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and op1_pii.find_base("0" * 5000 + "256.1.1.1") == []
    for unit in ("ab/", "a-b_", "09af", "0", "0.", "1 ", "+1", "+", "a@", "a@b.", "(+1 "):
        op1_pii.find_base(unit * (1_000_000 // len(unit)))


def pii_texts():
    """Fernsby and the words that start with "zyg" or "quok" come with one number each; "now" and "ok" come everywhere."""
    near = [f"{x} ring Quentin Fernsby at +44 20 7946 0958 now {y}" for x, y in (("please", "ok"), ("do", "then"), ("so", "or"), ("and", "but"))]
    forms = [f"ok zygo{i}tes at 10.9.8.7 now quok{'abcdefgh'[i]}{i} and 4111 1111 1111 1111 ok" for i in range(8)]
    crowd = [f"the word now and ok {i} at noon prefix prefer zy" for i in range(40)]
    return [*near, *forms, *crowd, None, "", "a@b.co " * 3000, near[0], near[0], near[0], "Mail a.b@c.de from 10.0.0.1, \u0130zmir 12345", "x@y.zz", "prefab x@y.zz prelude!"]


def pii_added(texts, remove=0.9):
    """All added spans by counting: per text a list of (removed, start, end), in order."""
    rows = [t or "" for t in texts]
    spans, near = [pii_base(t) for t in rows], []
    for text, found in zip(rows, spans, strict=True):
        words = [m.span() for m in re.finditer(r"\w+", text) if not any(m.start() < b and a < m.end() for _, a, b in found)]
        out = []
        for kind, a, b in found:
            value = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else re.sub("[^0-9]", "", text[a:b])
            out += [(kind + value, s, e) for s, e in [w for w in words if w[1] <= a][-5:] + [w for w in words if w[0] >= b][:5]]
        near.append(out)
    shapes = [(lambda w: w), (lambda w: w[:4] + "*" if len(w) > 4 else None), (lambda w: w[:2] + "*" if len(w) > 2 else None)]
    held = [{g for w in re.findall(r"\w+", t) for f in shapes if (g := f(w.lower()))} for t in rows]
    beside = [{(c, g) for c, s, e in n for f in shapes if (g := f(t[s:e].lower()))} for t, n in zip(rows, near, strict=True)]
    entities = [{c for c, _, _ in n} for n in near]

    def share(c, form):
        if form is None:
            return math.inf
        both, df, df_c = sum((c, form) in x for x in beside), sum(form in x for x in held), sum(c in x for x in entities)
        bound = (both + 0.5 - math.sqrt(both * (df - both) / df + 0.25)) / (df + 1)
        return math.log2(bound * len(rows) / df_c) / math.log2(len(rows) / df_c) if df_c < len(rows) else 0.0

    out = []
    for text, n in zip(rows, near, strict=True):
        level = {}
        for c, s, e in n:
            of = [share(c, f(text[s:e].lower())) for f in shapes]
            if of[0] >= 0.6:
                level[s, e] = max(level.get((s, e), 0), 4 if of[0] >= remove else 1 if of[1] < 0.6 else 2 if of[2] < 0.6 else 3)
        out.append(sorted((x > 3, s, e, x) for (s, e), x in level.items()))
    return out


@pytest.mark.parametrize("times", [1, 2])
def test_pii(spark, times):
    texts = pii_texts() * times
    rows = op1_pii.pii_digests(table(spark, texts), remove=0.85).collect()
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    wanted, levels = [], set()
    for text, added in zip(texts, pii_added(texts, 0.85), strict=True):
        base = pii_base(text or "")
        all_ = base + [("removed" if gone else "term", a, b) for gone, a, b, _ in added]
        wanted.append((*(sum(k == s[0] for s in base) for k in op1_pii.KINDS), digest(join(base)), join(all_)))
        levels |= {x for *_, x in added}
    same([tuple(r)[1:] for r in rows], wanted)
    assert levels == {1, 2, 3, 4} if times == 1 else levels


def test_pii_sanitise(spark):
    texts = pii_texts()
    docs = table(spark, texts)
    out = op1_pii.sanitise(docs, length_col="n_chars")
    assert out.schema == docs.schema
    rows = out.collect()
    assert len(rows) == docs.count() and not any(pii_base(r.text or "") for r in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    wanted = []
    for text, added in zip(texts, pii_added(texts), strict=True):
        spans = [(a, b, f"[{k.upper()}]") for k, a, b in pii_base(text or "")]
        spans += [(a, b, {1: text[a : a + 4] + "*", 2: text[a : a + 2] + "*", 3: "[NUMBER]" if text[a:b].isdigit() else "[WORD]", 4: ""}[x]) for _, a, b, x in added]
        for a, b, label in sorted(spans, reverse=True):
            text = text[:a] + label + text[b:]
        wanted.append(text)
    same([r.text for r in rows], wanted)
    assert op1_pii.sanitise(docs.limit(0)).count() == 0 and op1_pii.pii_digests(docs.limit(0)).count() == 0


# Secrets


def secret_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", op2_secrets.ASSIGN.replace("(?i:", "(?ai:"), 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    added = set()
    for _, pattern, window, bits in op2_secrets.CLASSES:
        for m in re.finditer(pattern, text):
            value = m.group()
            if not any(re.fullmatch(a, value) for a in (*op2_secrets.ALLOW, "[A-Za-z]+([-_/+][A-Za-z]+)+")):
                dummies = [d.span() for d in re.finditer(op2_secrets.DUMMY, value)]
                for i in range(len(value) - window + 1):
                    w = value[i : i + window]
                    if not any(i < e and s < i + window for s, e in dummies) and -sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w)) > bits:
                        added.add((m.start(), 3, m.end(), "entropy"))
    return sorted(found), sorted(added)


def test_secrets(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFghijkl0123456789+/_-abcdef"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = ["é🙂 " * 3 + 'api_key: "token": "abcdefghijklmnop" x=token=secret=abcdefghijklmn', None, "", "deadbeef" * 5, f"PASSWORD='{word(40)}'", " ".join(word(rng.randint(10, 60)) for _ in range(150)), "ſecret=abcdefghijklmn toKen=abcdefghijklmn", "a" * 3000, "token=abcdefghijklmnop" * 150, "550e8400-e29b-41d4-a716-446655440000 AKIAABCDEFGHIJKLMN", "plain words only", "docs/example/q8Zr5LkX0vT2mB7wYc4HsN1dGfJ3 EXAMPLEq8Zr5LkX0vT2m", "docs/guide-for/new_users docs/guide-/for--new_users/of-all"]
    rows = op2_secrets.scan_digests(table(spark, texts)).collect()
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    wanted = []
    for text in texts:
        base, added = secret_spans(text or "")
        wanted.append((*(sum(s[1] == k for s in base) for k in range(3)), digest(join(base)), join(base + added)))
    same([tuple(r)[1:] for r in rows], wanted)
    assert any("entropy" in w[-1] for w in wanted)
    plan = op2_secrets.scan_digests(table(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_secrets_in_megabytes_of_each_class(spark):
    """No kind of run takes more stack than another, nor time that grows with its square."""
    rng = random.Random(2)
    long = lambda alphabet, n=1 << 20: "".join(rng.choices(alphabet, k=n))
    texts = [("ab/" * 350_000) + "ab", "a-b_" * 260_000, long("0123456789abcdef"), "0123456789" * 100_000, long("+/_-", 1 << 18), long("ABCDEFGHIJKLMNOPabcdefghijkl0123456789+/_-", 1 << 18), "token" * 200_000, "token=" * 170_000, "token" + " " * 1_000_000, "AKIA" * 250_000, "550e8400-e29b-41d4-a716-446655440000-" * 3000, "example/" * 120_000, "\n" * 1_000_000]
    rows = {r.doc_id: r for r in op2_secrets.scan_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert len(rows) == len(texts)
    for i in (0, 1, 3, 4, 11, 12):
        assert "entropy" not in rows[i].spans, i
    assert rows[2].spans == f"hex:0:{1 << 20},entropy:0:{1 << 20}" and rows[5].spans == f"entropy:0:{1 << 18}"
    assert rows[9].spans == "access:0:1000000" and rows[9].n_access == 1


# SimHash


def components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[j] for j in range(n) if linked(i, j)] + [label[i]])
            changed |= low != label[i]
            label[i] = low
    return label


@pytest.mark.parametrize("cap", [1024, 4])
def test_simhash(spark, cap):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \n", "one", "ONE", "two words", *base, *(b.replace("w1", "W1") for b in base[:4]), *(" ".join([*b.split()[:-1], "end"]) for b in base for _ in range(2)), base[0] + " x"]
    rows = op3_simhash.simhash_components(table(spark, texts), cap=cap).collect()
    ids = [None if i % 9 == 8 else i // 2 * 2 for i in range(len(texts))]
    import xxhash

    def fingerprint(text):
        words = re.findall("[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for t in texts]
    label = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = defaultdict(list)
    for i, x in zip(ids, label, strict=True):
        least[x] += [i] if i is not None else []
    same([tuple(r) for r in rows], [(i, f"{f:016x}", min(least[x], default=None)) for i, f, x in zip(ids, fps, label, strict=True)])
    assert op3_simhash.simhash_components(table(spark, texts).limit(0)).count() == 0


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 5, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 7), replace=False))) for b in base for _ in range(60)], np.uint64))
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    a, b = op3_simhash.close_pairs(fps, np.zeros(len(fps), int))
    near = np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


# Chats


@needs_files
@pytest.mark.parametrize("most", [1 << 20, 50])
def test_chats(spark, most):
    odd = [None, "", r"\### Assistant: </turn> ok", "<|turn|>user<|says|>\\", "🙂 é </turn", "a" * 500, "<|endoftext|>"]
    rows = [(i % 6 if i % 6 else None, i // 6, ("user", "assistant", "system", None, "</turn>")[i % 5], odd[i % 7], i) for i in range(80)] + [(1, 0, "user", "tie", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c long")
    got = {r.conv_id: r for r in op4_chat.format_chats(df, BPE, most_chars=most).collect()}
    assert len(got) == 6
    for conv, row in got.items():
        turns = sorted((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), digest(loss))
    assert op4_chat.format_chats(df.limit(0), BPE).count() == 0


# Languages


def test_languages(spark):
    rng = random.Random(3)
    words = {"aa": ["thon", "ering", "wham", "and"], "bb": ["zück", "lich", "öft", "und"]}
    say = lambda l, n: " ".join(rng.choice(words[l]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 40), x) for i in range(200) for x in words], "doc_id long, text string, lang string")
    model = op5_langid.fit(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1").collect()
    import pyarrow as pa

    ll = model.mean_log(pa.array([r.text for r in held]))
    assert np.mean([model.languages[i] == r.lang for i, r in zip(ll.argmax(axis=1), held, strict=True)]) > 0.98
    page = lambda l, x: f'<html lang="{l}"><head><script>if (a<b) x()</script></head><body>{x}<!-- y --></body></html>'
    pages = [(1, "http://x.aa/1", page("aa", say("aa", 30))), (2, None, page("bb", say("bb", 30))), (3, "http://x.aa/2", "<p>12 345 %%%"), (4, "bad", None), (5, "http://x.aa/3", "<p>" + say("bb", 50) + "<script>"), (5, "http://x.aa/3", "")]
    rows = op5_langid.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    same([(r.page_id, r.language) for r in rows], [(1, "aa"), (2, "bb"), (3, None), (4, None), (5, "bb"), (5, None)])
    docs = spark.createDataFrame([(1, say("aa", 20), "aa", "s"), (2, "", "aa", "s"), (3, None, None, None), (4, "0 1 2", "bb", "s"), (4, say("bb", 20), "zz", "s")], "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in op5_langid.filter_documents(docs, model).collect()) == [1, 4]
    assert op5_langid.filter_documents(docs, op5_langid.fit(docs.limit(0))).count() == 5
    assert op5_langid.filter_documents(docs.limit(0), model).count() == 0


def test_language_sample_counts_different_texts(spark):
    few = [f"the quick brown fox number {w} jumps over the lazy dog" for w in ("one", "two", "three")]
    rows = [(t, "en", "a.org") for t in few for _ in range(400)] + [(f"der schnelle braune fuchs {i} springt", "de", "b.org") for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    model = op5_langid.fit(docs, per_language=4)
    assert model.languages == ["de", "en"]
    assert (model.log.max(axis=1) > model.log.min(axis=1)).all()
    assert op5_langid.filter_documents(docs, model).filter("lang = 'en'").count() == 1200


def spoken(language, n, rng):
    parts = {"aa": ["thon", "ering", "wham", "and"], "bb": ["zück", "lich", "öft", "und"], "cc": ["thon", "lich", "qu", "aux"]}[language]
    return " ".join(rng.choice(parts) + rng.choice(parts) for _ in range(n))


def test_languages_equal_a_count_by_hand(spark):
    """The whole posterior: likelihoods, declared languages, smoothed priors of suffix, domain and host, own counts taken out."""
    rng = random.Random(21)
    labels = ["aa", "bb", "cc"]
    docs = spark.createDataFrame([(spoken(x, 30, rng), x) for x in labels for _ in range(40)], "text string, lang string")
    model = op5_langid.fit(docs, per_language=1000)
    hosts = ["www.x.co.uk", "y.co.uk", "a.b.de", "b.de", "c.fr", "", "x.fr", "u.gov.au"]
    pages = []
    for i in range(160):
        language, host = rng.choice(labels), rng.choice(hosts)
        said = rng.choice([f'<html lang="{language}">', f'<html lang="{rng.choice(labels)}">', "<html>", '<html lang="zz">'])
        text = spoken(language, rng.choice([0, 1, 2, 8, 30]), rng) if i % 20 else "12 %% 34"
        pages.append((i % 150, f"https://{host}/p{i}" if host else None, f"{said}<body><p>{text}</p>", "h", "s"))
    schema = "page_id long, url string, html string, host string, suffix string"
    got = op5_langid.identify_pages(spark.createDataFrame(pages, schema), model, weight=0.2).collect()

    def grams(text):
        raw = bytes((c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32) for c in text.encode())
        return [(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32 >> 18 for i in range(len(raw) - 2) if raw[i : i + 3] != b"   "]

    counts = {x: defaultdict(int) for x in labels}
    for r in docs.collect():
        for g in grams(r.text):
            counts[r.lang][g] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    judged = []
    for page, url, source, *_ in pages:
        text, said = op5_langid.page_text(source)
        g = grams(text)
        ll = [sum(math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * 16384)) for b in g) / len(g) + math.log(16384) if g else -math.inf for x in labels]
        host = (url or "https:///").split("/")[2]
        parts = host.split(".")
        general = len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in op5_langid.GENERAL
        own = ll.index(max(ll)) if max(ll) > 0.5 else None
        judged.append((page, said, (parts[-1], ".".join(parts[-3:] if general else parts[-2:]), host), ll, own))
    kind = lambda said: "none" if said is None else said if said in labels else "other"
    sure = [j for j in judged if j[4] is not None]
    kinds = [*labels, "none", "other"]
    share = {k: sum(kind(j[1]) == k for j in sure) + 1 for k in kinds}
    share = {k: v / sum(share.values()) for k, v in share.items()}
    wanted = []
    for page, said, levels, ll, own in judged:
        score = []
        for i in range(3):
            prior = (sum(j[4] == i for j in sure) + 1) / (len(sure) + 3)
            for k in range(3):
                here = [j for j in sure if j[2][k] == levels[k]]
                mine = 1 if own is not None else 0
                prior = (sum(j[4] == i for j in here) - (own == i) + 20 * prior) / (len(here) - mine + 20)
            of = [j for j in sure if j[4] == i]
            declared = (sum(kind(j[1]) == kind(said) for j in of) + 20 * share[kind(said)]) / (len(of) + 20)
            score.append(max(ll[i], -1e6) * 0.2 + math.log(declared) + math.log(prior))
        p = [math.exp(x - max(score)) for x in score]
        p = [x / sum(p) for x in p]
        best = max(p)
        wanted.append((page, labels[p.index(best)] if own is not None and best >= 0.5 else None, round(best, 5) if own is not None else None, None if own is None else labels[own], said, levels[2]))
    same([(r.page_id, r.language, None if r.confidence is None else round(r.confidence, 5), r.text_language, r.declared, r.host) for r in got], wanted)
    assert {None, *labels} == {w[1] for w in wanted} and any(w[1] != w[3] for w in wanted if w[1])


def planted_languages(rng, junk_labels):
    """600 documents of three languages, and 100 of junk or of languages that the corpus doesn't have, which may bear a label."""
    clean = [(i, spoken(x, rng.randint(4, 60), rng), x, "s", 1) for i, x in enumerate(["aa", "bb", "cc"] * 200)]
    make = [lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)), lambda: "".join(rng.choice("ABCDefgh0123456789+/") for _ in range(200)), lambda: " ".join(rng.choice(["мягких", "булок", "ещё", "Москва"]) for _ in range(30)), lambda: " ".join(rng.choice(["kaikki", "ihmiset", "syntyvät", "vapaina"]) for _ in range(30)), lambda: "0 1 2 %%% $$"]
    return clean, [(1000 + i, make[i % 5](), rng.choice(junk_labels), "s", 1) for i in range(100)]


@pytest.mark.parametrize("junk_labels", [["aa", "bb", None], ["aa"], ["aa", "bb", "cc"], [None]])
def test_the_stage_rejects_junk_and_foreign_text_that_bears_labels(spark, junk_labels):
    import corpus_pipeline

    clean, planted = planted_languages(random.Random(22), junk_labels)
    docs = spark.createDataFrame(clean + planted, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert sum(i < 1000 for i in kept) == 600 and sum(i >= 1000 for i in kept) <= 2


def test_a_label_of_two_scripts_keeps_both(spark):
    rng = random.Random(23)
    turned = str.maketrans("abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x44A))))
    rows = [(i, spoken("aa", 40, rng), "aa", "s", 1) for i in range(120)] + [(200 + i, spoken("aa", 40, rng).translate(turned), "aa", "s", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert op5_langid.filter_documents(docs, op5_langid.fit(docs), declared_col=None).count() == 200


def test_odd_labels_fit(spark):
    rows = [("only text of its label", "xx"), ("%% 1", "yy"), ("%% 1", "YY"), ("", "zz"), (None, "zz"), *((spoken("bb", 9, random.Random(i)), "bb") for i in range(20))]
    model = op5_langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["bb", "xx", "yy"]


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(op5_langid, "MOST_LABELS", 2)
    rows = spark.createDataFrame([("a text", x) for x in ("aa", "bb", "cc")], "text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        op5_langid.fit(rows)


def test_page_text():
    for source in ("<script" * 150_000, "<!--" * 200_000, "<" * 1_000_000, "<a " * 300_000, "<html " * 150_000, "<style>" * 140_000, "< " * 500_000):
        op5_langid.page_text(source)
    read = lambda s: " ".join(op5_langid.page_text(s)[0].split())
    assert read("a<b>c</b>&amp;<script>x</script>d<style>y") == "a c & d y"
    assert read("if a < b and c<3 then <i>d</i> e <unclosed and more") == "if a < b and c<3 then d e <unclosed and more"
    assert read("x<!-- gone --> y <!-- kept") == "x y kept"
    assert op5_langid.page_text("<html" + " x" * 3000 + " lang='FR'>")[1] == "fr" and op5_langid.page_text("<p lang=fr>")[1] is None


# SentencePiece


@needs_files
def test_sentencepiece(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", " a  b", "▁▁a ▁b", "日本語 🙂 é", "<s> <0x0A>", "a\tb\r\nc", *("".join(rng.choice("ab  ▁\n<s>/é🙂0") for _ in range(60)) for _ in range(60)), "word " * 5000]
    rows = op6_sentencepiece.encode(table(spark, texts), SPM, ids=True)
    got = rows.collect()
    assert len(got) == len(texts) and all(r.parity and r.round_trip for r in got)
    back = op6_sentencepiece.decode(rows, SPM).collect()
    same([r.text for r in back], [(t or "").replace("▁", " ") for t in texts])
    assert op6_sentencepiece.encode(table(spark, texts).limit(0), SPM).count() == 0


def unigram_model(byte_fallback, dummy_prefix, remove_extra):
    """A unigram model's file, written by hand: every string of up to two of a few characters and some words, with random scores."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    rng = random.Random(31)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    letters = "▁abcdé語"
    words = {*letters, *(a + b for a in letters for b in letters[1:]), "▁abc", "abcd", "▁a", "▁▁", "bad", "▁dada", "cab"}
    # Sums of such scores are exact in single precision, so that "c cc" and "cc c" tie in both libraries.
    pieces += [(w, -rng.randint(256, 1152) / 128, 1) for w in sorted(words)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(score)) + field(3, kind)) for p, score, kind in pieces)
    out += field(2, field(3, 1) + field(4, len(pieces)) + field(35, int(byte_fallback)))
    return out + field(3, field(1, b"identity") + field(3, int(dummy_prefix)) + field(4, int(remove_extra)) + field(5, 1))


@pytest.mark.parametrize(("byte_fallback", "dummy_prefix", "remove_extra"), [(True, True, False), (True, False, True), (False, True, True)])
def test_sentencepiece_unigram(spark, tmp_path, byte_fallback, dummy_prefix, remove_extra):
    import sentencepiece

    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(byte_fallback, dummy_prefix, remove_extra))
    rng = random.Random(32)
    texts = [None, "", " ", "  a  b ", "abcd bad dada cab", *("".join(rng.choice("aabbccdd  é語🙂x") for _ in range(rng.randint(0, 40))) for _ in range(300)), "abc dab " * 3000]
    rows = op6_sentencepiece.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(path), ids=True, verify=False).collect()
    reference = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for r in rows:
        wanted = reference.encode(texts[r.doc_id] or "")
        assert r.ids == wanted, texts[r.doc_id]
        assert r.n_tokens == len(wanted) and r.ids_crc32 == zlib.crc32(np.array(wanted, "<u4").tobytes())
    assert len(rows) == len(texts) and len({i for r in rows for i in r.ids}) > 40


# Packing


@needs_files
def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [None, "", "don't I'll 'something '' it's\n\n  x  y", "日本語 ½ ² <|endoftext|>", "<|endoftext|>", "x <|endoftext|><|endoftext|> y<|endoftext", "|>", "a" * 5000, *(" ".join(rng.choice(["ab.", "cd", "ef!", "\n"]) for _ in range(rng.randint(1, 900))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = op7_packing.pack_documents(docs, BPE, chunk=4000).collect()
    tokenizer = Tokenizer.from_file(BPE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *(p.length for p in s[:-1])]).tolist()
        n = sum(p.length for p in s)
        assert n <= 1024
        padding += 0 if n.bit_count() == 1 else 1024 - n
        total += n
    assert padding < 0.05 * total
    assert op7_packing.pack_documents(docs.limit(0), BPE).count() == 0


@needs_files
def test_ids_are_the_librarys():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from auditloom.llm._arrow import flat_bytes
    from auditloom.llm.bytebpe import WordEncoder

    rng = random.Random(15)
    texts = [None, *("".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", " ", "a", "'s", "é", "\n", "7", "🙂", "　"]) for _ in range(rng.randint(0, 12))) for _ in range(3000))]
    for as_text in (False, True):
        tokenizer, words = Tokenizer.from_file(BPE), WordEncoder(BPE, special_as_text=as_text)
        tokenizer.encode_special_tokens = as_text
        for part in (texts[:1], texts[:700], texts[700:], ["<|endoftext|>"], ["", ""], ["a", "<|endoftext|>", "b"]):
            ids, at = words.encode(*flat_bytes(pa.array(part, pa.string())))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_cuts_are_the_best():
    rng = np.random.default_rng(6)
    for _ in range(60):
        points = np.concatenate([[0], np.cumsum(rng.integers(1, 8, 14))])
        costs = np.concatenate([[0], rng.integers(0, 5, 13), [0]])
        cuts = op7_packing.choose_cuts(points, costs, 16, True)
        price = dict(zip(points.tolist(), costs.tolist(), strict=True))
        best = {0: 0}
        for j in points[1:].tolist():
            best[j] = min(best[i] + 16 - (j - i) for i in points.tolist() if i < j <= i + 16) + price[j]
        assert sum(16 - (b - a) + price[b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) == best[points[-1]]


# Repeats


def repeats(texts, depth):
    data = [(t or "").encode() for t in texts]
    at = defaultdict(list)
    for i, b in enumerate(data):
        for s in range(len(b) - depth + 1):
            at[b[s : s + depth]].append((i, s))
    covered = [bytearray(len(b)) for b in data]
    for where in at.values():
        for i, s in where if len(where) > 1 else ():
            covered[i][s : s + depth] = b"\1" * depth
    return [(len(b), sum(c), sum(1 for i in range(len(c)) if c[i] and not (i and c[i - 1])), hashlib.sha256(bytes(x for x, y in zip(b, c, strict=True) if not y)).hexdigest()) for b, c in zip(data, covered, strict=True)]


@pytest.mark.parametrize("cap", [2000, 3])
def test_repeats(spark, cap):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages, line = [text(rng.randint(20, 700)) for _ in range(8)], text(150)
    texts = [None, "", "short", "short", text(199), "a" * 700, "ab" * 200, text(250)]
    texts += ["".join(rng.choice([*passages, text(90), line])[rng.choice([0, 0, 5]) :] for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts += [texts[20]] * 3 + ["x" + texts[20], texts[20] + "y"] + [text(120) + passages[0][:260] + text(120) for _ in range(15)]
    docs = table(spark, texts)
    rows = op10_suffix.repeat_digests(docs, cap=cap).collect()
    same([tuple(r)[1:] for r in rows], repeats(texts, 200))
    out = op10_suffix.remove_repeats(docs, length_col="n_chars", cap=cap)
    assert out.schema == docs.schema and out.count() == len(texts)
    assert op10_suffix.repeat_digests(docs.limit(0)).count() == 0


def test_shards_merge():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 60))).encode() for _ in range(50)]
    groups = np.sort(np.array([rng.randint(0, 2) for _ in texts]))
    whole = [op10_suffix.shard_repeats([t for t, h in zip(texts, groups, strict=True) if h == g], np.zeros((groups == g).sum(), int), 12) for g in range(3)]
    parts = [op10_suffix.shard_repeats([t for t, h in zip(texts, groups, strict=True) if h == g], np.zeros((groups == g).sum(), int), 12, shard=150) for g in range(3)]
    assert all((a == b).all() for x, y in zip(whole, parts, strict=True) for a, b in zip(x, y, strict=True))
