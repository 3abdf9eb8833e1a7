"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint is taken from a text's word shingles in one pass. Fingerprints that differ in at most ``most`` = 3 of 64
bits agree on one of four 16-bit blocks, so each distinct fingerprint goes to four groups, one a block. In a group they
are sorted by Gray rank, which puts those with few differing bits side by side. Runs of ``FANOUT`` neighbours become
nodes: the bits all members share are factored into the node as a masked pattern, runs of nodes become upper nodes. The
search goes down from pairs of roots; a pair's differences add up on the bits that both sides have fixed so far, and whole
groups of fingerprints are dropped once the sum exceeds ``most``.

A group over ``cap`` fingerprints is dealt anew: by four 12-bit blocks of its other 48 bits, of which one must agree too, and
what is still over ``cap`` by pairs of hash-dealt parts of about ``cap / 2``. So no task gets an unbounded group and no link is
lost. A task returns a spanning forest of each group's links, not the links.

Rows with one fingerprint are one class before any of this; classes are joined back to rows at the end.

Defined cases: a null or blank text has fingerprint zero; a null doc_id has a row of its own and isn't chosen as component_id
unless its whole component has no other; repeated doc_ids are rows of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import lean, ranges, slices
from auditloom.llm._graph import components, forest
from auditloom.llm._store import keep, save, temporary

MOST, FANOUT, CAP, SEED = 3, 8, 1024, 42
#: Pairs looked at together in numpy.
PAIRS = 1 << 21


def text_fingerprints(texts: list[str], width: int = 3) -> np.ndarray:
    """SimHash of each text: words parted by ASCII white space, A-Z in lower case, shingles of ``width`` words."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else (b" ".join(words),)
        before = len(hashes)
        hashes += [xxh64_intdigest(s, SEED) for s in shingles]
        sizes[i] = len(hashes) - before
    some = np.flatnonzero(sizes)
    out = np.zeros(len(texts), np.uint64)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits((2 * counts > sizes[some][:, None]).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, columns of keep): fp holds the 64 bits as a signed long."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                fp = text_fingerprints(batch.column(1).fill_null("").to_pylist(), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *keep])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), *keep)
    kept = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long{kept}")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the reflected Gray code, moved so that signed order is its order."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class _Level:
    """Nodes of one level: the bits that all members of a node share, and where its children begin."""

    def __init__(self, mask: np.ndarray, bits: np.ndarray, group: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.mask, self.bits, self.group, self.first, self.size = mask, bits, group, first, size


def _build(fps: np.ndarray, group: np.ndarray) -> list[_Level]:
    """Levels over fingerprints sorted by group and Gray rank, leaves (single fingerprints) first."""
    everywhere = np.full(len(fps), np.uint64(0xFFFFFFFFFFFFFFFF))
    levels = [_Level(everywhere, fps, group, np.arange(len(fps)), np.ones(len(fps), np.int64))]
    while True:
        low = levels[-1]
        begins = np.flatnonzero(np.concatenate([[True], low.group[1:] != low.group[:-1]]))
        counts = np.diff(np.append(begins, len(low.group)))
        if (counts == 1).all():
            return levels
        place = np.arange(len(low.group)) - np.repeat(begins, counts)
        first = np.flatnonzero(place % FANOUT == 0)
        size = np.diff(np.append(first, len(low.group)))
        ones = np.bitwise_and.reduceat(low.bits & low.mask, first)
        zeros = np.bitwise_and.reduceat(~low.bits & low.mask, first)
        levels.append(_Level(ones | zeros, ones, low.group[first], first, size))


def close_pairs(fps: np.ndarray, group: np.ndarray, most: int = MOST, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within a group that differ in at most ``most`` bits; input sorted by group and Gray rank."""
    levels = _build(fps, group)
    top = levels[-1]
    a = b = np.arange(len(top.group))
    stack = [(len(levels) - 1, a, b, np.zeros(len(a), np.int64), np.zeros(len(a), np.uint64))]
    found: list = []
    while stack:
        k, a, b, gone, fixed = stack.pop()
        level = levels[k]
        both = level.mask[a] & level.mask[b]
        gone = gone + np.bitwise_count((level.bits[a] ^ level.bits[b]) & both & ~fixed)
        live = gone <= most
        a, b, gone, both = a[live], b[live], gone[live], both[live]
        if not k:
            apart = a < b
            found.append((a[apart], b[apart]))
            continue
        for start in range(0, len(a), max(1, PAIRS // FANOUT**2)):
            part = slice(start, start + max(1, PAIRS // FANOUT**2))
            x, y = a[part], b[part]
            times = level.size[y]
            down_a = ranges(level.first[x], level.size[x])
            pair_of = np.repeat(np.arange(len(x)), level.size[x])
            down_b = ranges(level.first[y][pair_of], times[pair_of])
            row = np.repeat(np.arange(len(down_a)), times[pair_of])
            down_a, pair_of = down_a[row], pair_of[row]
            once = down_a <= down_b
            stack.append((k - 1, down_a[once], down_b[once], gone[part][pair_of[once]], both[part][pair_of[once]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _link(most: int):
    """Over rows (key..., fp) sorted by key and Gray rank: a spanning forest of each group's links."""

    def chunks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fps, keys, held = [], [], 0
        for batch in batches:
            keys.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns - 1)]))
            fps.append(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            held += batch.num_rows
            if held >= rows:
                key, fp = np.concatenate(keys, axis=1), np.concatenate(fps)
                new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
                if len(new):
                    yield key[:, : new[-1]], fp[: new[-1]]
                    keys, fps, held = [key[:, new[-1] :]], [fp[new[-1] :]], len(fp) - new[-1]
                else:
                    keys, fps = [key], [fp]
        if held:
            yield np.concatenate(keys, axis=1), np.concatenate(fps)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in chunks(batches):
            group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
            a, b = close_pairs(fp, group, most)
            a, b = forest(len(fp), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["u", "v"])

    return run


def _dealt(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Links of groups by ``keys``, each small enough for one task."""
    by_key = rows.repartition(*keys)
    return by_key.sortWithinPartitions(*keys, gray_rank(F.col("fp"))).select(*keys, "fp").mapInArrow(_link(most), "u long, v long")


def _over(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    return rows.groupBy(*keys).count().filter(F.col("count") > cap)


def links(fps: DataFrame, most: int = MOST, cap: int = CAP) -> DataFrame:
    """(u, v): edges that connect what the links among distinct fingerprints ``fp`` connect. ``most`` is 3 or less."""
    if not 0 <= most <= 3:
        raise ValueError("four blocks find differences of at most 3 bits")
    blocks = F.array(*(F.struct(F.lit(t).alias("t"), F.shiftrightunsigned("fp", 16 * t).bitwiseAND(0xFFFF).cast("int").alias("key")) for t in range(4)))
    rows = fps.select("fp", F.inline(blocks))
    keys = ["t", "key"]
    hot = save(_over(rows, keys, cap), "hot")
    if hot.isEmpty():
        return _dealt(rows, keys, most)
    out = _dealt(rows.join(hot.select(*keys), keys, "left_anti"), keys, most)
    # The other 48 bits, block t taken out.
    bit = lambda n: f"shiftrightunsigned(fp, {n})"
    rest = F.expr(f"CASE t WHEN 0 THEN {bit(16)} WHEN 1 THEN ({bit(32)} << 16) | (fp & 65535) WHEN 2 THEN ({bit(48)} << 32) | (fp & 4294967295) ELSE fp & 281474976710655 END")
    parts = F.array(*(F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("rest", 12 * s).bitwiseAND(0xFFF).cast("int").alias("part")) for s in range(4)))
    finer = save(rows.join(hot.select(*keys), keys).withColumn("rest", rest).select("t", "key", "fp", F.inline(parts)), "finer")
    keys = ["t", "key", "s", "part"]
    hot = save(_over(finer, keys, cap), "hot")
    out = out.union(_dealt(finer.join(hot.select(*keys), keys, "left_anti"), keys, most))
    if hot.isEmpty():
        return out
    n = F.ceil(F.col("count") * 2 / cap).cast("int")
    deal = finer.join(hot, keys).withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")))
    return out.union(_dealt(deal.select(*keys, "fp", F.inline(pairs)), [*keys, "i", "j"], most))


def _classes(rows: DataFrame, most: int, cap: int) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint."""
    distinct = save(rows.select("fp").distinct(), "distinct")
    of = components(links(distinct, most, cap))
    return distinct.join(of, distinct.fp == of.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = MOST, cap: int = CAP) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of ``docs``."""
    with temporary():
        rows = keep(save(fingerprints(docs, id_col, text_col, width), "fingerprints"))
        named = rows.groupBy("fp").agg(F.min("id").alias("least")).join(_classes(rows, most, cap), "fp")
        named = keep(save(named, "classes"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes, "fp").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")
