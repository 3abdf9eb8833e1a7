"""Near-duplicates by shingle similarity: wide SimHash fingerprints, Gray-order index, exact check.

Two texts are near-duplicates if their sets of ``width``-word shingles have a Jaccard similarity of ``least`` = 0.8 or more. At 0.8 two 64-bit
fingerprints differ in 10 bits on average, too many for blocks of one fingerprint. So each different text gets ``WORDS`` fingerprints of 64 bits
from its set of shingles, and goes to a group for each 16-bit block of each. A pair at 0.8 agrees on a block with probability 0.072, on one of 48
with 0.97; at 0.9 with 0.9999 (before the cuts below, and for many shingles: fewer lose more). In a group the Gray-order index finds pairs that differ in at most ``NEAR`` bits of the first fingerprint,
those over ``FAR`` bits of the first four go, as do pairs whose set sizes rule 0.8 out.

Of a group's pairs each text hands on two: with its nearest partner, and with the partner of most partners (the text that a family of
copies was made from). All groups together give a text many partners, and each pair is then checked on whole texts, so no pair below ``least``
links. Groups over ``cap`` are dealt finer, by one more block of the fingerprint, and what is still larger in hash-dealt parts of ``cap``, so the work
is linear in the texts of a group.

These links only spare work (so they may be cut short where that is cheaper): what they leave apart is compared without loss. In one order of all shingles, rare ones first, two sets at ``least`` share
one of the first n - ceil(least * n) + 1 of each (prefix filter). Texts meet in a group for each such shingle, and every pair there that no
link has joined yet goes to the exact check, but for those that set sizes, places in the order or parities of 1,024 buckets of shingles (each a
bound on what two sets share) rule out. A family of n texts below ``least`` that share their rare shingles costs work of n squared.

Equal texts are one node throughout. Nodes are named by 64-bit hashes of MD5.

Defined cases: null counts as empty; texts without words are one class, and resemble no others; a text of fewer than ``width`` words is one shingle;
of repeated rows one stays; null ids sort last; an empty table gives no rows; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import lean, ranges, slices
from auditloom.llm._graph import components
from auditloom.llm._store import drop, keep, save, temporary
from auditloom.llm.op3_simhash import PAIRS, SEED, close_pairs, gray_rank

WORDS, KEPT, NEAR, FAR, CAP, LEAST = 12, 4, 16, 52, 4096, 0.8
#: Rows of groups that are searched together.
ROWS = 1 << 13
#: Texts whose shingles are counted for the order, shingles whose counts are kept, and longs of a set's parities.
SAMPLE, COMMON, PARITIES = 1 << 13, 1 << 17, 16
#: Rows of the second step: a shingle, and a text of a root, with its set's size and the shingle's place in the set's order.
COLUMNS = ["g", "root", "node", "n", "i"]
#: The bits of a byte as eight bytes, so that one addition counts eight bits of up to 255 hashes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_set(text: str, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else (b" ".join(words),)
    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of hashes, one family a seed: two rounds of multiplication and shift."""
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def wide_fingerprints(sets: list[np.ndarray], words: int = WORDS) -> np.ndarray:
    """SimHash of each set (rows) by word (columns); a bit is set if over half of the set's hashes have it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), words), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        hashes, sizes = np.concatenate(sets), sizes[some]
        runs = -(-sizes // 255)
        first = np.cumsum(runs) - runs
        within = np.arange(int(runs.sum())) - np.repeat(first, runs)
        starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * within
        for k in range(words):
            lanes = np.add.reduceat(LANES[_mixed(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8)], starts, axis=0)
            counts = np.add.reduceat(lanes.view(np.uint8), first, axis=0, dtype=np.int32)
            out[some, k] = np.packbits((2 * counts > sizes[:, None]).astype(np.uint8), axis=1).view(">u8").ravel()
    return out


def _fingerprinted(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, w: WORDS fingerprints) of (node, t); texts without words are left out."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                w = wide_fingerprints(sets).view(np.int64)
                some = sizes > 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, WORDS * int(some.sum()) + 1, WORDS, dtype=np.int32)), pa.array(w[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(sizes[some]), lists], names=["node", "n", "w"])

    return texts.mapInArrow(run, "node long, n long, w array<long>")


def chosen(node: np.ndarray, n: np.ndarray, w: np.ndarray, group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes to check, at most two a row; input sorted by group and Gray rank of the first fingerprint."""
    a, b = close_pairs(w[:, 0], group, NEAR)
    fits = (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])) & (node[a] != node[b])
    a, b = a[fits], b[fits]
    apart = sum(np.bitwise_count(w[a, k] ^ w[b, k]).astype(np.int16) for k in range(w.shape[1]))
    near = apart <= FAR
    a, b, apart = a[near], b[near], apart[near]
    partners = np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))
    x, y, apart = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([apart, apart])
    u, v = [], []
    for order in (np.lexsort((node[y], apart, x)), np.lexsort((node[y], apart, -partners[y], x))):
        first = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])] if len(order) else order
        u.append(node[x[first]])
        v.append(node[y[first]])
    u, v = np.concatenate(u), np.concatenate(v)
    return np.minimum(u, v), np.maximum(u, v)


def _search(least: float):
    """Over rows (g, node, n, w0..) sorted by g and Gray rank: the pairs to check."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((KEPT + 3, 0), np.int64)

        def pairs(x: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate([[0], np.cumsum(x[0, 1:] != x[0, :-1])])
            # A row alone in its group has no partner.
            size = np.bincount(group)
            x, group = x[:, size[group] > 1], group[size[group] > 1]
            if not x.shape[1]:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["u", "v"])
            u, v = chosen(x[1], x[2], np.ascontiguousarray(x[3:].T).view(np.uint64), group, least)
            pair = np.unique(np.stack([u, v]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["u", "v"])

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(KEPT + 3)])], axis=1)
                new = np.flatnonzero(held[0, 1:] != held[0, :-1]) + 1
                if held.shape[1] >= ROWS and len(new):
                    yield pairs(held[:, : new[-1]])
                    held = held[:, new[-1] :]
        if held.shape[1]:
            yield pairs(held)

    return run


def candidates(prints: DataFrame, cap: int = CAP, least: float = LEAST) -> DataFrame:
    """(u, v) with u < v: pairs of nodes of ``prints`` (node, n, w) to check."""
    words = [F.col("w")[k].alias(f"w{k}") for k in range(KEPT)]
    names = [f"w{k}" for k in range(KEPT)]
    block = lambda k, s: F.shiftrightunsigned(F.col("w")[k], 16 * s).bitwiseAND(0xFFFF)
    groups = F.array(*((F.lit((4 * k + s) << 16) + block(k, s)).cast("long") for k in range(WORDS) for s in range(4)))
    rows = prints.select(F.explode(groups).alias("g"), "node", "n", *words)

    def found(dealt: DataFrame) -> DataFrame:
        return dealt.sortWithinPartitions("g", gray_rank(F.col("w0"))).select("g", "node", "n", *names).mapInArrow(_search(least), "u long, v long")

    hot = save(rows.groupBy("g").count().filter(F.col("count") > cap), "hot")
    if hot.isEmpty():
        return found(rows.repartition("g")).distinct()
    out = found(rows.join(hot, "g", "left_anti").repartition("g"))
    # Which word and block a group is of: the other blocks of that word divide it. Texts that agree on none of them are left to the second step.
    word, own = F.expr("w[cast(g div 262144 as int)]"), F.expr("cast(g div 65536 % 4 as int)")
    others = F.filter(F.array(*(F.lit(i) for i in range(4))), lambda i: i != own)
    value = lambda i: F.expr("shiftrightunsigned(word, 16 * i)").bitwiseAND(0xFFFF)
    held = prints.select(F.explode(groups).alias("g"), "node", "n", "w", *words).join(hot, "g").withColumn("word", word)
    finer = held.select("g", "node", "n", "word", *names, F.explode(others).alias("i")).withColumn("g", F.xxhash64("g", "i", value(F.col("i")))).drop("word", "i")
    over = finer.groupBy("g").count().filter(F.col("count") > cap)
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / cap))
    dealt = finer.join(over, "g", "left").withColumn("g", F.when(F.col("count").isNotNull(), F.xxhash64("g", part)).otherwise(F.col("g")))
    return out.union(found(dealt.repartition("g"))).distinct()


def _common(texts: DataFrame, width: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, texts of a sample that have them): only the order rests on it, so what a sample misses costs time, not links."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, width) for t in batch.column(1).to_pylist()]).view(np.int64))], names=["s"])

    step = -(-many // SAMPLE) or 1
    counts = texts.filter(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).dropDuplicates(["node"]).mapInArrow(run, "s long").groupBy("s").count()
    rows = counts.filter("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    shingles, times = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(shingles)
    return shingles[order], times[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set in the common order, so many that sets of similarity ``least`` share one."""
    known, times = common
    rank = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, times[at], 0)
    n = len(shingles)
    return shingles[np.lexsort((shingles, rank))][: n - int(np.ceil(least * n - 1e-9)) + 1]


def parities(one: np.ndarray, longs: int) -> np.ndarray:
    """Whether each bucket of a set's shingles holds an odd number, as bits of so many longs."""
    bits = 64 * longs
    bucket = (one % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(bucket, minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def wide(one: np.ndarray) -> np.ndarray:
    """Parities of four buckets or more a shingle, a power of two times PARITIES longs."""
    return parities(one, PARITIES << max(0, int(np.ceil(np.log2(len(one) / (16 * PARITIES))))))


def folded(odd: np.ndarray, longs: int) -> np.ndarray:
    """The parities of fewer buckets: with a power of two fewer, buckets that are the same modulo their number fall together."""
    return np.bitwise_xor.reduce(odd.reshape(-1, longs), axis=0)


def _prefixed(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int, least: float) -> DataFrame:
    """(node, n, p: prefix, odd: parities, wide: wide parities) of (node, t) with words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
                some = np.array([len(s) > 0 for s in sets], bool)
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                odd = [wide(s) for s in sets]
                lists = []
                for parts in ([prefix(s, common, least) for s in sets], [folded(o, PARITIES) for o in odd], odd):
                    ends = np.concatenate([[0], np.cumsum([len(f) for f in parts])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64))))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array([len(s) for s in sets], pa.int64()), *lists], names=["node", "n", "p", "odd", "wide"])

    return texts.mapInArrow(run, "node long, n long, p array<long>, odd array<long>, wide array<long>")


def plausible(pairs: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """The pairs that wide parities allow. At four buckets a shingle few pairs much under ``least`` are left, and none at it is lost."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True)):
                x, y = np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64)
                longs = min(len(x), len(y))
                near[i] = np.bitwise_count(folded(x, longs) ^ folded(y, longs)).sum(dtype=np.int64) * (1 + least) <= (1 - least) * n[i] + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["u", "v"])

    left, right = (prefixes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"o{c}")) for c in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "ou", "nv", "ov").mapInArrow(run, "u long, v long")


def _several():
    """Of rows (g, root, node, n, i) sorted by g and root: those of groups with several roots, and of some large ones with one."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_group = np.zeros((5, 0), np.int64), None
        for batch in batches:
            x = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(5)])], axis=1)
            if not x.shape[1]:
                continue
            begins = np.flatnonzero(np.append(True, x[0, 1:] != x[0, :-1]))
            size = np.diff(np.append(begins, x.shape[1]))
            several = x[1, begins] != x[1, begins + size - 1]
            several[0] |= x[0, 0] == open_group
            # The last group may go on; what isn't told yet waits, but no more of it than a few batches.
            several[-1] |= size[-1] > 8 * ROWS
            open_group = x[0, -1] if several[-1] else None
            keep = np.repeat(several, size)
            held = x[:, begins[-1] :] if not several[-1] else x[:, :0]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x[:, keep]], names=COLUMNS)

    return run


def crossing(x: np.ndarray, odd: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different roots in a group that sizes, places and parities allow; x: rows g, root, node, n, i, sorted by g and root."""
    g, root, node, n, i = x
    total = x.shape[1]
    last = np.searchsorted(np.flatnonzero(np.append(g[1:] != g[:-1], True)), np.arange(total))
    end = np.flatnonzero(np.append(g[1:] != g[:-1], True))[last] + 1
    turn = np.flatnonzero(np.append((g[1:] != g[:-1]) | (root[1:] != root[:-1]), True))
    after = turn[np.searchsorted(turn, np.arange(total))] + 1
    work = np.cumsum(end - after)
    start = 0
    while start < total:
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + PAIRS, "right")))
        b = ranges(after[start:stop], (end - after)[start:stop])
        a = np.repeat(np.arange(start, stop), (end - after)[start:stop])
        fits = np.minimum(n[a] - i[a], n[b] - i[b]) * (1 + least) >= least * (n[a] + n[b]) - 1e-6
        fits &= np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-6
        a, b = a[fits], b[fits]
        for k in range(0, len(a), ROWS):
            c, d = a[k : k + ROWS], b[k : k + ROWS]
            # Sets at least apart differ in (1 - least) / (1 + least) of their sizes' sum at most, and in each bucket of unequal parity once or more.
            near = np.bitwise_count(odd[c] ^ odd[d]).sum(axis=1, dtype=np.int64) * (1 + least) <= (1 - least) * (n[c] + n[d]) + 1e-6
            u, v = node[c[near]], node[d[near]]
            if len(u):
                yield tuple(np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1))
        start = stop


def _cross(least: float):
    """Over rows (g, root, node, n, i, odd) sorted by g and root: the pairs that may reach ``least``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def pairs() -> Iterator[pa.RecordBatch]:
            for u, v in crossing(np.concatenate([x for x, _ in held], axis=1), np.concatenate([o for _, o in held]), least):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = np.stack([batch.column(k).to_numpy() for k in range(5)])
                odd = np.asarray(batch.column(5).flatten()).view(np.uint64).reshape(-1, PARITIES)
                new = np.flatnonzero(x[0] != np.append(held[-1][0][0, -1] if held else x[0, :1], x[0, :-1]))
                if rows + x.shape[1] >= ROWS and len(new):
                    held.append((x[:, : new[-1]], odd[: new[-1]]))
                    yield from pairs()
                    held, rows = [(x[:, new[-1] :], odd[new[-1] :])], x.shape[1] - int(new[-1])
                else:
                    held.append((x, odd))
                    rows += x.shape[1]
        if held:
            yield from pairs()

    return run


def remaining(prefixes: DataFrame, roots: DataFrame, cap: int = CAP, least: float = LEAST) -> DataFrame:
    """(u, v) with u < v: all pairs that may reach ``least`` and are not of one root. roots: (node, root)."""
    schema = "g long, root long, node long, n long, i long"
    rows = prefixes.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("p").alias("i", "g"))
    rows = rows.select("g", "root", "node", "n", F.col("i").cast("long").alias("i"))
    shared = save(rows.repartition("g").sortWithinPartitions("g", "root").select(*COLUMNS).mapInArrow(_several(), schema), "shared")
    # Groups over the cap are dealt by pairs of hash-dealt parts of about half of it.
    sizes = shared.groupBy("g").count().filter(F.col("count") > cap)
    parts = F.coalesce(F.ceil(F.col("count") * 2 / cap), F.lit(1)).cast("int")
    dealt = shared.join(sizes, "g", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("own", other).alias("a"), F.greatest("own", other).alias("b")))
    tiled = dealt.select(*COLUMNS, "parts", F.inline(tiles)).withColumn("g", F.when(F.col("parts") > 1, F.xxhash64("g", "a", "b")).otherwise(F.col("g")))
    known = tiled.select(*COLUMNS).join(prefixes.select("node", "odd"), "node")
    return known.repartition("g").sortWithinPartitions("g", "root").select(*COLUMNS, "odd").mapInArrow(_cross(least), "u long, v long").distinct()


def _checked(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs whose whole texts are similar enough."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            # Rows come in runs of one end, so the last set of each end is kept.
            last: list[tuple] = [(None, None), (None, None)]
            for i in range(batch.num_rows):
                for end in (0, 1):
                    if (one := batch.column(end)[i].as_py()) != last[end][0]:
                        last[end] = (one, shingle_set(batch.column(2 + end)[i].as_py(), width))
                (one, x), (other, y) = last
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= least * (len(x) + len(y) - both):
                    u.append(one)
                    v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    left, right = (texts.select(F.col("node").alias(c), F.col("t").alias(f"t{c}")) for c in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = LEAST, cap: int = CAP) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of least id (nulls last), then least MD5 of its text."""
    with temporary():
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        key = F.md5(text)
        # Texts of white space alone share a node.
        node = F.when(text.rlike(r"[^\x09-\x0D\x20]"), F.xxhash64(key)).otherwise(F.lit(0).cast("long"))
        nodes = docs.select(F.col(id_col).alias("id"), key.alias("dedup_key"), node.alias("node"))
        some = docs.select(node.alias("node"), text.alias("t")).filter("node != 0")
        prints = save(_fingerprinted(some, width).dropDuplicates(["node"]), "prints")

        def checked(pairs: DataFrame) -> DataFrame:
            ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            texts = save(some.join(ends, "node", "left_semi").groupBy("node").agg(F.min("t").alias("t")), "texts")
            linked = save(_checked(pairs, texts, width, least), "linked")
            drop(texts)
            return linked

        common = _common(some, width, prints.count())
        prefixes = save(_prefixed(some, common, width, least).dropDuplicates(["node"]), "prefixes")
        pairs = save(candidates(prints, cap, least), "pairs")
        near = save(plausible(pairs, prefixes, least), "near")
        linked = checked(near)
        rest = remaining(prefixes, components(linked), cap, least).join(pairs, ["u", "v"], "left_anti")
        rest = save(plausible(rest, prefixes, least), "rest")
        drop(prints, pairs, near, prefixes)
        roots = components(linked.union(checked(rest)))
        rooted = nodes.join(roots, "node", "left").select("id", "dedup_key", F.coalesce("root", "node").alias("root"))
        return keep_one(docs, rooted, id_col, key)


def keep_one(docs: DataFrame, rooted: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` with one row of each root of ``rooted`` (id, dedup_key, root); ``key`` gives dedup_key of a row of docs."""
    named = keep(save(rooted.select("root", F.struct(F.col("id").isNull().alias("none"), "id", F.col("dedup_key").alias("md5")).alias("row")), "members"))
    # A root may have a third of all rows: rows are dealt by a salt too, and a root goes to the salts that it has.
    salted = named.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(64)).cast("int"))
    least = salted.groupBy("root").agg(F.count("*").alias("c"), F.min("row").alias("least"), F.expr("bit_or(shiftleft(1L, s))").alias("salts")).filter("c > 1")
    least = least.select("root", "least", F.explode(F.expr("filter(sequence(0, 63), x -> (shiftrightunsigned(salts, x) & 1L) = 1L)")).alias("s"))
    gone = salted.join(least, ["root", "s"]).filter(~F.col("row").eqNullSafe(F.col("least"))).select(F.xxhash64("row").alias("h"), F.col("row").alias("gone")).distinct()
    same = named.groupBy("row").count().filter("count > 1").select(F.xxhash64("row").alias("h"), F.col("row").alias("same"))
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("md5"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("held"), own.alias("own")).withColumn("h", F.xxhash64("own"))
    held = held.join(gone, (held.h == gone.h) & held.own.eqNullSafe(gone.gone), "left_anti")
    twice = keep(save(same, "same"))
    if twice.isEmpty():
        return held.select("held.*")
    single = held.join(twice, (held.h == twice.h) & held.own.eqNullSafe(twice.same), "left_anti").select("held.*")
    several = held.join(twice, (held.h == twice.h) & held.own.eqNullSafe(twice.same), "left_semi").dropDuplicates(["own"]).select("held.*")
    return single.unionByName(several)
