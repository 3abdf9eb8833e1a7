"""Patches from two versions of a file, and files from patches.

Lines are matched by patience: lines that stand once in either version, taken in the longest order they share, split the rest into
stretches that are matched alike; stretches without such lines go to a greedy search for the least edits (Myers), and if they need more than
``MOST_EDITS``, are replaced whole. A patch is therefore always right, and least wherever that is affordable. Versions are
compared row by row in Arrow batches, which Spark bounds by rows and bytes, and results leave in slices; nothing is shuffled.
"""

from __future__ import annotations

import ctypes
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 2
#: Edits beyond which a stretch is replaced whole; the search holds a row of numbers for each edit.
MOST_EDITS = 400
#: Characters of results that a task gathers before it passes them on.
SLICE = 1 << 20
NO_NEWLINE = "\\ No newline at end of file"
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def lines_of(text: str) -> list[str]:
    """Lines with their line feeds; the last one may lack it."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + parts[-1:] * bool(parts[-1])


def _anchors(a: list[str], b: list[str], i: int, m: int, j: int, n: int) -> list[tuple[int, int]]:
    """Pairs of lines that stand once in a[i:m] and once in b[j:n], in the longest order that both share."""
    seen: dict[str, int | None] = {}
    for k in range(j, n):
        seen[b[k]] = None if b[k] in seen else k
    once: dict[str, int | None] = {}
    for k in range(i, m):
        once[a[k]] = None if a[k] in once else k
    pairs = [(k, seen[line]) for line, k in once.items() if k is not None and seen.get(line) is not None]
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for at, (_, y) in enumerate(pairs):
        place = bisect_left(tails, y)
        before.append(ends[place - 1] if place else -1)
        tails[place : place + 1], ends[place : place + 1] = [y], [at]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def _least(a: list[str], b: list[str], i: int, m: int, j: int, n: int) -> list[tuple[int, int]]:
    """Matched pairs of a[i:m] and b[j:n] by the least edits, or none if they are too many."""
    far, rows = {1: 0}, []
    for d in range(min(m - i + n - j, MOST_EDITS) + 1):
        rows.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            while x < m - i and 0 <= x - k < n - j and a[i + x] == b[j + x - k]:
                x += 1
            far[k] = x
            if x >= m - i and x - k >= n - j:
                return _traced(rows, d, m - i, n - j, i, j)
    return []


def _traced(rows: list[dict[int, int]], d: int, x: int, y: int, i: int, j: int) -> list[tuple[int, int]]:
    out = []
    for step in range(d, -1, -1):
        far, k = rows[step], x - y
        if step:
            up = k == -step or (k != step and far[k - 1] < far[k + 1])
            px = far[k + 1] if up else far[k - 1]
            py = px - (k + 1 if up else k - 1)
            sx, sy = (px, py + 1) if up else (px + 1, py)
        else:
            px = py = sx = sy = 0
        while x > sx and y > sy:
            x, y = x - 1, y - 1
            out.append((i + x, j + y))
        x, y = px, py
    return out[::-1]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal lines that both versions keep, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if anchors := _anchors(a, b, i, m, j, n):
            out += anchors
            x, y = i, j
            for p, q in [*anchors, (m, n)]:
                todo.append((x, p, y, q))
                x, y = p + 1, q + 1
        else:
            out += _least(a, b, i, m, j, n)
    return sorted(out)


def unified(path: str, before: str | None, after: str | None, context: int = CONTEXT) -> str:
    """The patch that makes ``after`` of ``before``; '' if they are equal. None is a file that isn't there."""
    if before == after:
        return ""
    a, b = lines_of(before or ""), lines_of(after or "")
    ops: list[tuple[str, int, int]] = []
    i = j = 0
    for p, q in [*matches(a, b), (len(a), len(b))]:
        ops += [("-", k, j) for k in range(i, p)] + [("+", p, k) for k in range(j, q)] + ([(" ", p, q)] if p < len(a) and q < len(b) else [])
        i, j = p + 1, q + 1
    changed = [k for k, op in enumerate(ops) if op[0] != " "]
    names = [f"a/{path}" if before is not None else "/dev/null", f"b/{path}" if after is not None else "/dev/null"]
    out = [f"diff --git a/{path} b/{path}", f"--- {names[0]}", f"+++ {names[1]}"]
    at = 0
    while at < len(changed):
        end = at
        while end + 1 < len(changed) and changed[end + 1] - changed[end] <= 2 * context + 1:
            end += 1
        hunk = ops[max(0, changed[at] - context) : changed[end] + context + 1]
        old, new = sum(op[0] != "+" for op in hunk), sum(op[0] != "-" for op in hunk)
        out.append(f"@@ -{hunk[0][1] + bool(old)},{old} +{hunk[0][2] + bool(new)},{new} @@")
        for sign, x, y in hunk:
            line = b[y] if sign == "+" else a[x]
            out.append(sign + line.removesuffix("\n"))
            if not line.endswith("\n"):
                out.append(NO_NEWLINE)
        at = end + 1
    return "\n".join(out) + "\n"


def apply(before: str | None, patch: str) -> str:
    """What a patch makes of a text; raises ValueError where its lines aren't those of the text."""
    a, out, at = lines_of(before or ""), [], 0
    rows = patch.split("\n")[: -1 if patch.endswith("\n") else None]
    k = next((k for k, row in enumerate(rows) if _HUNK.match(row)), len(rows))
    while k < len(rows):
        head = _HUNK.match(rows[k])
        if not head:
            raise ValueError(f"no hunk: {rows[k]!r}")
        old, new = (int(head[g]) if head[g] is not None else 1 for g in (2, 4))
        start = int(head[1]) - bool(old)
        out += a[at:start]
        at, k = start, k + 1
        while k < len(rows) and (old or new or rows[k] == NO_NEWLINE):
            sign, line = rows[k][:1], rows[k][1:]
            if rows[k] != NO_NEWLINE:
                line += "" if k + 1 < len(rows) and rows[k + 1] == NO_NEWLINE else "\n"
                if sign != "+":
                    if at >= len(a) or a[at] != line:
                        raise ValueError(f"line {at + 1} isn't {line!r}")
                    at, old = at + 1, old - 1
                if sign != "-":
                    out.append(line)
                    new -= 1
            k += 1
    return "".join(out + a[at:])


def sliced(make: Callable[..., str | None], columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """``make`` of each row, passed on whenever ``SLICE`` characters are made: a row's texts at a time are Python's, whatever a batch holds."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    for batch in columns:
        out, size = [], 0
        for row in zip(*batch, strict=True):
            out.append(make(*(value.as_py() for value in row)))
            size += len(out[-1] or "")
            if size >= SLICE:
                yield pa.array(out, pa.string())
                out, size = [], 0
        if out:
            yield pa.array(out, pa.string())
        del batch, out
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def _column(make: Callable[..., str | None], *columns: Column) -> Column:
    def run(batches):
        return sliced(make, batches)

    run.__annotations__ = {"batches": Iterator[tuple[(pa.Array,) * len(columns)]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(*columns)


def patch_column(path: Column, before: Column, after: Column, context: int = CONTEXT) -> Column:
    """The unified patch of two versions; null where both are null."""

    def made(path: str | None, before: str | None, after: str | None) -> str | None:
        return None if before is None and after is None else unified(path or "", before, after, context)

    return _column(made, path, before, after)


def patched_column(before: Column, patch: Column) -> Column:
    """What the patch makes of a version; null where it doesn't fit or is null."""

    def made(before: str | None, patch: str | None) -> str | None:
        try:
            return None if patch is None else apply(before, patch)
        except ValueError:
            return None

    return _column(made, before, patch)
