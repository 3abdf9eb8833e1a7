"""Exact removal of repeated byte strings by suffix arrays of content-dealt shards.

A byte goes if a string of ``depth`` = 200 bytes that covers it starts anywhere else too, in the same text or another. All
strings are judged on the input.

1. Dealing. Each window (200 bytes) has an anchor: its k-byte string of least hash. Equal windows have equal anchors, at
   the same place, so windows can only repeat where an anchor does, and a run of windows with one anchor (a unit) is compared within
   that anchor's group alone. Anchors are counted by combined sums; units whose anchor comes once are dropped at once.
2. Equal units of a group are combined to a kind before any text is shuffled; two of its members stand for it.
3. The members' texts are dealt to shards by anchor. A shard builds its suffix array (Larsson-Sadakane refinement), its common prefixes
   (Kasai) and so the classes of equal windows. A group that runs on over several shards of a task has them merged by binary search of one's
   windows among the sorted windows of the others. What repeats is decided here only, on the bytes.
4. A group with over ``cap`` kinds is not sent to one task: its members' texts are dealt anew by longer anchors (120, 180 and
   200 bytes, the last being whole windows), which every window again contains, so the groups fall apart and nothing is lost.
5. A kind's repeated windows are those of all its units, which a join of hashes finds.

Hot keys: a third of all units may have one anchor or be of one kind, and a third of all rows one text. So units are counted
together with the set of 64 salts that they have, and joins are on the salt too: each side stays linear in the units. Texts are told apart by
their MD5 and a salt of the row's id.

Defined cases: a null text counts as empty; texts under 200 bytes keep all; null and repeated doc_ids are carried, each row being a text
of its own (so equal rows repeat each other); an empty table gives no rows; extra columns are carried by ``remove_repeats`` and
ignored by ``repeat_digests``; ``remove_repeats`` needs no id column, which serves for a salt there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import flat_bytes, lean, ranges, slices
from auditloom.llm._store import drop, save

DEPTH, ANCHORS, CAP = 200, (40, 120, 180, 200), 2000
#: Bytes of text that are looked at together, bytes of a shard (which the processor's caches hold), and bytes of texts held for shards.
SLICE, SHARD, HELD = 1 << 19, 1 << 18, 1 << 21
SALTS = 64
_UNITS = "a long, u long, s int, key binary, base int, n int"
_RANGES = "array<struct<s:int,e:int>>"


def _key(text: Column, salt: Column) -> Column:
    """Names a text; rows of one text and different salts have names of their own."""
    return F.concat(F.unhex(F.md5(text)), F.unhex(F.lpad(F.hex(salt), 2, "0")))


def _salts(salt: str) -> Column:
    """The set of a group's salts, as bits."""
    return F.expr(f"bit_or(shiftleft(1L, {salt}))")


def _each(salts: str) -> Column:
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), x -> (shiftrightunsigned({salts}, x) & 1L) = 1L)"))


def _pieces(data: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a long text that overlap by depth - 1 bytes, so that each window lies in exactly one."""
    most = 4 * SLICE
    for start in range(0, max(1, len(data) - depth + 1), most):
        yield start, data[start : start + most + depth - 1]


def _units(rows: DataFrame, k: int, depth: int) -> DataFrame:
    """Units of rows (key, t). Their salt is even over a hot anchor's units, and the same on a rerun."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from auditloom.llm._suffix import anchor_units

        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                names, begin = flat_bytes(batch.column(0))
                row_salt = names[begin[:-1]].astype(np.int64) * 7 + names[begin[1:] - 1]
                data, offsets = flat_bytes(batch.column(1))
                parts = [(0, data, offsets)] if batch.num_rows > 1 else [(at, x, np.array([0, len(x)])) for at, x in _pieces(data, depth)]
                for at, x, off in parts:
                    text, start, count, _, anchor, unit = anchor_units(x, off, k, depth)
                    base = start + at
                    salt = (row_salt[text] + base) % SALTS
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(unit.view(np.int64)), pa.array(salt.astype(np.int32)), batch.column(0).take(pa.array(text)), pa.array(base.astype(np.int32)), pa.array(count.astype(np.int32))], names=["a", "u", "s", "key", "base", "n"])

    return rows.mapInArrow(run, _UNITS)


def _kinds(rows: DataFrame, level: int, depth: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, t): the units whose anchor comes again, and their kinds (a, u, salts, members, hot)."""
    units = _units(rows, ANCHORS[level] if depth == DEPTH else max(1, depth * ANCHORS[level] // DEPTH), depth)
    # Written, so that the joins read plain exchanges and the adaptive join can split what salts leave.
    often = save(units.groupBy("a").agg(F.count("*").alias("c"), _salts("s").alias("salts")).filter("c > 1").select("a", _each("salts").alias("s")), "often")
    shared = save(units.join(often, ["a", "s"], "left_semi"), "shared")
    member = F.struct("key", "base", "n")
    kinds = save(shared.groupBy("a", "u").agg(F.count("*").alias("c"), _salts("s").alias("salts"), F.min(member).alias("one"), F.max(member).alias("other")).withColumn("d", F.pmod("u", F.lit(SALTS)).cast("int")), "kinds")
    hot = kinds.groupBy("a").agg(F.count("*").alias("m"), _salts("d").alias("ds")).filter(F.col("m") > cap).select("a", _each("ds").alias("d"), F.lit(True).alias("hot"))
    members = F.array_compact(F.array("one", F.when(F.col("c") > 1, F.col("other"))))
    out = save(kinds.join(hot, ["a", "d"], "left").select("a", "u", "salts", members.alias("members"), F.coalesce("hot", F.lit(False)).alias("hot")), "sized")
    drop(often, kinds)
    return shared, out


def _texts(rows: DataFrame, kinds: DataFrame, depth: int) -> DataFrame:
    """The members of kinds (a, u, members, hot), each with its text: (a, u, hot, t)."""
    of = kinds.select("a", "u", "hot", F.explode("members").alias("x")).select("a", "u", "hot", "x.*")
    wanted = save(of.groupBy("key").agg(F.collect_list(F.struct("a", "u", "hot", "base", "n")).alias("units")), "wanted")
    names = ["a", "u", "hot", "t"]
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            out: list = []
            size = 0
            for key, text, units in zip(*(batch.column(i) for i in range(3)), strict=True):
                if (k := key.as_py()) in seen:
                    continue  # a copy, and its units are the same
                seen.add(k)
                if len(seen) > 100_000:
                    seen.clear()
                data = text.as_buffer().to_pybytes()
                for x in units.as_py():
                    out.append((x["a"], x["u"], x["hot"], data[x["base"] : x["base"] + x["n"] - 1 + depth]))
                    size += len(out[-1][3])
                if size > SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    texts = save(rows.join(wanted, "key").select("key", "t", "units").mapInArrow(run, "a long, u long, hot boolean, t binary"), "texts")
    drop(wanted)
    return texts


def _sorted_windows(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Windows as fixed strings, in order."""
    return np.sort(data[starts[:, None] + np.arange(depth)].view(f"S{depth}").ravel())


def shard_repeats(texts: list[bytes], groups: np.ndarray, depth: int, shard: int = SHARD, times: np.ndarray | None = None) -> list[np.ndarray]:
    """For units in order of group: which windows of each unit also start elsewhere in its group. A unit may stand for ``times`` equal ones."""
    from auditloom.llm._suffix import window_classes

    times = np.ones(len(texts), np.int64) if times is None else times
    sizes = np.array([len(t) for t in texts], np.int64)
    part = np.cumsum(sizes) // shard
    found: list = [None] * len(texts)
    merged: list = []  # shards of the group that runs on: windows in order, their places, their repeats
    running = None
    for p in np.unique(part).tolist():
        mine = np.flatnonzero(part == p)
        data = np.frombuffer(b"".join(texts[i] for i in mine), np.uint8)
        begin = np.cumsum(sizes[mine]) - sizes[mine]
        counts = sizes[mine] - depth + 1
        starts = ranges(begin, counts)
        same = window_classes(data, starts, depth)
        again = np.bincount(same, np.repeat(times[mine], counts))[same] > 1
        for i, flags in zip(mine.tolist(), np.split(again, np.cumsum(counts)[:-1]), strict=True):
            found[i] = flags.copy()
        first, last = groups[mine[0]], groups[mine[-1]]
        if running is not None and first == running:
            own = mine[groups[mine] == first]
            cells = _sorted_windows(data, starts[: int(counts[: len(own)].sum())], depth)
            for cells_before, own_before in merged:
                for i, other in [(i, cells) for i in own_before] + [(i, cells_before) for i in own.tolist()]:
                    x = np.frombuffer(texts[i], np.uint8)
                    w = x[np.arange(len(x) - depth + 1)[:, None] + np.arange(depth)].view(f"S{depth}").ravel()
                    at = np.minimum(np.searchsorted(other, w), len(other) - 1)
                    found[i] |= other[at] == w
        if running != last:
            merged, running = [], last
        own = mine[groups[mine] == last]
        tail = int(counts[: len(mine) - len(own)].sum())
        if p < part[-1]:
            merged.append((_sorted_windows(data, starts[tail:], depth), own.tolist()))
    return found


def _shards(texts: DataFrame, depth: int) -> DataFrame:
    """(a, u, ranges): of each kind the bytes that repeated windows cover, counted from the unit's start. texts: (a, u, t), groups by ``a``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def done(rows: list) -> pa.RecordBatch:
            # A kind's members stand together; equal bytes enter the suffix array once, with their number.
            new = np.flatnonzero([i == 0 or row != rows[i - 1] for i, row in enumerate(rows)])
            times = np.diff(np.append(new, len(rows)))
            rows = [rows[i] for i in new.tolist()]
            flags = shard_repeats([t for _, _, t in rows], np.array([a for a, _, _ in rows], np.int64), depth, times=times)
            sizes = np.array([len(f) + 1 for f in flags], np.int64)
            flat = np.zeros(int(sizes.sum()) + 1, np.int8)  # a zero before each unit's windows and one behind all
            begin = np.cumsum(sizes) - sizes
            flat[ranges(begin + 1, sizes - 1)] = np.concatenate(flags)
            edge = np.diff(flat)
            s, e = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            unit = np.searchsorted(begin, s, "right") - 1
            s, e = s - begin[unit], e - begin[unit] - 1 + depth
            some, first = np.unique(unit, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(s)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["s", "e"]))
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some.tolist()], pa.int64()), pa.array([rows[i][1] for i in some.tolist()], pa.int64()), lists], names=["a", "u", "ranges"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > HELD and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield done(held)

    return texts.select("a", "u", "t").repartition("a").sortWithinPartitions("a", "u").mapInArrow(run, f"a long, u long, ranges {_RANGES}")


def _decided(rows: DataFrame, depth: int, cap: int, level: int = 0) -> DataFrame:
    """(key, ranges): for rows (key, t) with repeated windows the bytes they cover, in any order."""
    shared, kinds = _kinds(rows, level, depth, cap)
    texts = _texts(rows, kinds, depth)
    found = _shards(texts.filter("NOT hot"), depth)
    hot = texts.filter("hot")
    # The last anchors are whole windows, of which a group has one kind.
    if level + 1 < len(ANCHORS) and not hot.isEmpty():
        named = F.unhex(F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("u"), 16, "0")))
        finer = _decided(hot.select(named.alias("key"), "t"), depth, cap, level + 1)
        found = found.union(kinds.filter("hot").select("a", "u", named.alias("key")).join(finer, "key").select("a", "u", "ranges"))
    found = save(found, "found")
    verdicts = found.join(kinds, ["a", "u"]).select("a", "u", "ranges", _each("salts").alias("s"))
    moved = F.transform("ranges", lambda x: F.struct((F.col("base") + x["s"]).alias("s"), (F.col("base") + x["e"]).alias("e")))
    spread = shared.join(verdicts, ["a", "u", "s"]).select("key", F.explode(moved).alias("x"))
    out = save(spread.groupBy("key").agg(F.collect_set("x").alias("ranges")), "ranges")
    drop(shared, kinds, texts, found)
    return out


def repeated_ranges(docs: DataFrame, depth: int = DEPTH, cap: int = CAP) -> DataFrame:
    """(key, ranges): for texts (key, t) with repeated windows, array<struct<s, e>> of the bytes they cover, in any order."""
    return _decided(docs.select("key", F.col("t").cast("binary").alias("t")), depth, cap)


def merge_ranges(ranges: list[tuple[int, int]], size: int, depth: int) -> list[tuple[int, int]]:
    """Maximal runs covered, clipped to a text of ``size`` bytes; texts shorter than a window have none."""
    out: list[list[int]] = []
    for s, e in sorted(ranges) if size >= depth else ():
        e = min(e, size)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _runs(text: str | None, ranges: list | None, depth: int) -> tuple[bytes, list[tuple[int, int]]]:
    data = (text or "").encode()
    return data, merge_ranges([(x["s"], x["e"]) for x in ranges], len(data), depth) if ranges else []


def _text_and_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    salt = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SALTS)) if id_col in docs.columns else F.lit(0)
    return text, _key(text, salt.cast("int"))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, cap: int = CAP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): a row for each row of ``docs``."""
    text, key = _text_and_key(docs, id_col, text_col)
    ranges = repeated_ranges(docs.select(key.alias("key"), text.alias("t")), depth, cap)
    held = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), key.alias("key")).join(ranges, "key", "left").select("doc_id", "t", "ranges")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, runs = _runs(text, ranges, depth)
                rows.append((len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(_cut(data, runs)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return held.mapInArrow(run, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to character edges, so that what is kept is valid UTF-8."""
    out = []
    for s, e in runs:
        while s < e and s < len(data) and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, depth: int = DEPTH, cap: int = CAP) -> DataFrame:
    """``docs`` without the repeated bytes; no character is split, and all rows stay. ``length_col`` is set to the new length."""
    text, key = _text_and_key(docs, id_col, text_col)
    ranges = repeated_ranges(docs.select(key.alias("key"), text.alias("t")), depth, cap)
    columns = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), key.alias("key")).join(ranges, "key", "left").select("row", "ranges")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = row.field(columns.index(text_col)).to_pylist()
            kept = []
            for text, ranges in zip(texts, batch.column(1).to_pylist(), strict=True):
                data, runs = _runs(text, ranges, depth)
                kept.append(_cut(data, _whole_characters(data, runs)).decode() if runs else text)
            arrays = [row.field(i) for i in range(len(columns))]
            arrays[columns.index(text_col)] = pa.array(kept, pa.string())
            if length_col:
                at = columns.index(length_col)
                arrays[at] = pa.array([None if t is None else len(t) for t in kept], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return held.mapInArrow(run, docs.schema)
