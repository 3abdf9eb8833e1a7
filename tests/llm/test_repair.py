"""Conversation repair against a search of all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from auditloom.llm import op13_repair as op

CLASHING = "conv_id long, turn long, role string, text string, c long, n long, initial string, copies long, seg long"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def least(rows):
    """(cost, audit, repaired) by trying all edits; rows: (role, text, fault)."""
    best = [(10**9, "", [])]

    def go(i, cost, audit, out, inserted):
        if cost > best[0][0]:
            return
        so_far = "".join(r[:1] or "?" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", so_far):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", so_far) and (cost, audit) < best[0][:2]:
            best[0] = (cost, audit, out)
        if inserted < 3:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*out, (role, "")], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*out, (new, text)], 0)

    # Deleting everything bounds the cost from above.
    best[0] = (3 * len(rows), "D" * len(rows), [])
    go(0, 0, "", [], 0)
    return best[0]


def by_hand(original, rows):
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            found = BLANK.findall(text)
            fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, made = least(judged)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return out


def sample(n=150, seed=5, most=6):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "U", "", None]
    texts = ["Yes.", "No", "", "\t \n", "What now?", "Fine! ", "…", None, "Yes.\x0b", "a:b\nc."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            rows.append((None if conv == 3 else conv, rng.choice([turn, turn, turn, turn + 3, None, -turn]), rng.choice(roles), rng.choice(texts)))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "i", 3, 4) for r in rows], CLASHING).repartition(parts)


def same(got, wanted):
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


@pytest.mark.parametrize("sizes", [{}, {"long_turns": 2}, {"long_bytes": 10, "long_turns": 3}])
def test_repair_of_damaged_conversations(spark, sizes):
    rows = sample()
    got = op.repair(op.damage(frame(spark, rows)), present="present", **sizes)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    same([tuple(r) for r in got.collect()], by_hand(rows, damaged(rows)))


def test_dropped_conversation_and_no_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = op.repair(op.damage(frame(spark, [(conv, 0, "user", "Yes.")], 1)), present="present").collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert op.repair(op.damage(frame(spark, []))).collect() == []


def test_small_batches_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "BATCH_ROWS", 7)
    rows = sample(40, seed=6)
    batches = frame(spark, rows, 1).select("conv_id").toArrow().rename_columns(["c"]).sort_by("c").to_batches(max_chunksize=3)
    tables = list(op._conversations(iter(batches)))
    assert len(tables) > 3 and sum(t.num_rows for t in tables) == len(rows)
    ends = [t.column("c").to_pylist() for t in tables]
    assert all(a[-1] != b[0] for a, b in zip(ends, ends[1:], strict=False))


@pytest.mark.parametrize("sizes", [{}, {"long_turns": 3}])
def test_repaired_turns_and_a_second_repair(spark, sizes):
    rows = sample(60, seed=7)
    turns = op.repair(frame(spark, rows), turns=True, **sizes)
    assert turns.columns == ["conv_id", "n", "edit", "role", "text"]
    found = defaultdict(list)
    for r in turns.orderBy("n").collect():
        found[r.conv_id].append((r.role, r.text))
    digests = {r.conv_id: r.repaired_sha256 for r in op.repair(frame(spark, rows), **sizes).collect()}
    for conv, digest in digests.items():
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in found[conv]).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in found[conv]))


def test_a_conversation_of_many_turns(spark):
    """Segments joined against the same query over the whole conversation at once."""
    rng = random.Random(8)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", ""]) + str(rng.randint(0, 60)) + rng.choice([".", ""])) for i in range(700)] + [(1, 5, "user", "again.")] * 300
    whole = op.repair(frame(spark, rows), long_turns=5000).collect()
    parts = op.repair(frame(spark, rows), long_turns=16).collect()
    same([tuple(r) for r in whole], [tuple(r) for r in parts])
    assert len(whole[0].audit) >= 1000
