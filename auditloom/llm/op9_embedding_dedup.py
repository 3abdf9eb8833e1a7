"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits unit vectors recursively: a node draws a random direction and parts its vectors at the median of a bounded
sample (``sample`` vectors, those of least hashed id). Vectors within ``spill`` of the cut go to both sides, though a vector is in at
most ``LEAVES`` leaves a tree. Vectors of one label are compared within each leaf of ``trees`` trees, in double precision; pairs at or
over the threshold are links and the union of all links gives the components.

A pair met in several leaves counts in the first one only: each vector carries its leaves in all trees, so a task sees whether
two vectors met before. Hence links need no shuffle: a task returns each vector's number of links and a spanning forest.
Equal vectors of a label are one node with a weight. A leaf's group over ``block`` nodes is dealt by pairs of parts.

Every vector is routed through every tree; the sample fixes cuts only. Measured recall of links: see the README.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without a label
or vectors of another length than the commonest; such rows are their own component and kept. Repeated ids are rows of their own. A
null id is kept if its component has no other. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import lean
from auditloom.llm._graph import components, forest
from auditloom.llm._store import keep, save, temporary
from auditloom.llm._vectors import dimension, matrix, usable

THRESHOLD, TREES, LEAVES, SAMPLE, LEAF, BLOCK, SEED = 0.93, 8, 4, 20_000, 1000, 1024, 64_93
#: Half width of the overlap, in standard deviations of a random projection (1 / sqrt(d)).
SPILL = 0.16


class Tree:
    """depth levels of random splits; node i has children 2i + 1 and 2i + 2."""

    def __init__(self, seed: int, d: int, depth: int, sample: np.ndarray, spill: float):
        self.depth, self.spill = depth, spill / np.sqrt(max(1, d))
        self.seed, self.d = seed, d
        self.cuts: dict[int, float] = {}
        level = {0: np.arange(len(sample))}
        for _ in range(depth):
            down: dict[int, np.ndarray] = {}
            for node, rows in level.items():
                if len(rows) < 16:
                    continue  # too few to fit a cut: such nodes split at 0
                along = sample[rows] @ self.direction(node)
                self.cuts[node] = cut = float(np.median(along))
                down[2 * node + 1], down[2 * node + 2] = rows[along <= cut], rows[along > cut]
            level = down

    def direction(self, node: int) -> np.ndarray:
        x = np.random.default_rng((self.seed, node)).standard_normal(self.d)
        return x / np.linalg.norm(x)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaves of each row, -1 where there are fewer than LEAVES, smallest leaf first."""
        who, node, spare = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), LEAVES // 2)
        for _ in range(self.depth):
            order = np.argsort(node, kind="stable")
            who, node, spare = who[order], node[order], spare[order]
            edges = np.flatnonzero(np.diff(node)) + 1
            along = np.empty(len(node))
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(node)], strict=True):
                if s < e:
                    along[s:e] = x[who[s:e]] @ self.direction(int(node[s])) - self.cuts.get(int(node[s]), 0.0)
            both = (np.abs(along) <= self.spill) & (spare > 0)
            child = 2 * node + 1 + (along > 0)
            spare = np.where(both, spare // 2, spare)
            who = np.concatenate([who, who[both]])
            node = np.concatenate([child, 4 * node[both] + 3 - child[both]])
            spare = np.concatenate([spare, spare[both]])
        order = np.lexsort((node, who))
        who, node = who[order], node[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        out = np.full((len(x), LEAVES), -1, np.int32)
        out[who, place] = node
        return out


def leaf_links(x: np.ndarray, weight: np.ndarray, leaves: np.ndarray, tree: int, leaf: int, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among unit rows that meet here first: (links of each row, a, b). With side, only pairs of different sides count."""
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    if side is not None:
        apart = side[a] != side[b]
        a, b = a[apart], b[apart]
    fresh = np.ones(len(a), bool)
    for t in range(tree + 1):
        la, lb = leaves[a, t], leaves[b, t]
        for i in range(LEAVES):
            for j in range(LEAVES):
                met = (la[:, i] == lb[:, j]) & (la[:, i] >= 0)
                fresh &= ~(met & (la[:, i] < leaf)) if t == tree else ~met
    a, b = a[fresh], b[fresh]
    links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
    return links.astype(np.int64), a, b


def _compare(rows: DataFrame, threshold: float, trees: int) -> DataFrame:
    """Rows (t, leaf, label, i, j, side, node, weight, v, leaves) in groups: (node, links, other): other is null or a node joined to it."""

    def done(key: tuple, node: np.ndarray, weight: np.ndarray, side: np.ndarray, x: np.ndarray, leaves: np.ndarray) -> tuple:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        links, a, b = leaf_links(x, weight, leaves.reshape(len(x), trees, LEAVES), key[0], key[1], threshold, side if key[3] != key[4] else None)
        a, b = forest(len(x), a, b)
        some = np.flatnonzero(links)
        return node[some], links[some], node[a], node[b]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()
            if one and one[0].num_rows > 1:
                r = one[0]
                n, links, a, b = done(now, *(r.column(i).to_numpy() for i in (6, 7, 5)), matrix(r.column(8)), matrix(r.column(9)).astype(np.int64))
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([n, a])), pa.array(np.concatenate([links, np.zeros(len(a), np.int64)])), pa.array(np.concatenate([n, b]))], names=["node", "links", "other"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            edges = (np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist()
            for s, e in zip([0, *edges], [*edges, len(keys)], strict=True):
                if s == e:
                    continue
                if tuple(keys[s].tolist()) != now:
                    if held:
                        yield from flush()
                    held, now = [], tuple(keys[s].tolist())
                held.append(batch.slice(s, e - s))
        if held:
            yield from flush()

    keys = ["t", "leaf", "label", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "node", "weight", "v", "leaves").mapInArrow(run, "node long, links long, other long")


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = TREES, spill: float = SPILL, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    d = dimension(rows.filter("ok"), "v")
    rows = rows.withColumn("ok", F.col("ok") & (F.coalesce(F.size("v"), F.lit(-1)) == d))
    nodes = rows.filter("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id())
    with temporary():
        named = keep(save(_named(save(nodes, "nodes"), d, threshold, trees, spill, sample, leaf, block), "named"))  # nodes are written once, so their numbers stay
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(least, "root").select("label", "v", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    inside = rows.filter("ok").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    outside = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.union(outside).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _named(nodes: DataFrame, d: int, threshold: float, trees: int, spill: float, sample: int, leaf: int, block: int) -> DataFrame:
    """(label, v, least, weight, links, root) of different vectors of a label, from a saved table of them."""
    n = nodes.count()
    taken = nodes.select("v", F.xxhash64("least", "node").alias("h")).orderBy("h").limit(sample).select("v").toArrow()  # at most ``sample`` vectors
    fit = matrix(taken.column("v").combine_chunks()) if taken.num_rows else np.zeros((0, d))
    fit = fit / np.linalg.norm(fit, axis=1, keepdims=True) if len(fit) else fit
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    wood = nodes.sparkSession.sparkContext.broadcast([Tree(SEED + t, d, depth, fit, spill) for t in range(trees)])
    kind = nodes.schema["v"].dataType.simpleString()

    @lean
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(3))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            found = np.concatenate([t.leaves(x) for t in wood.value], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "weight", "label", "v", "leaves"])

    routed = nodes.select("node", "weight", "label", "v").mapInArrow(route, f"node long, weight long, label long, v {kind}, leaves array<int>")
    placed = routed.select("*", F.posexplode("leaves").alias("place", "leaf")).filter("leaf >= 0").withColumn("t", F.expr(f"place div {LEAVES}").cast("int")).drop("place")
    group = ["t", "leaf", "label"]
    parts = placed.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("m")).filter("m > 1")
    dealt = placed.join(parts, group, "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("node"), "m").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("side", o).alias("i"), F.greatest("side", o).alias("j")))
    met = save(_compare(dealt.select("*", F.inline(pairs)), threshold, trees), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.filter("node != other").select(F.col("node").alias("u"), F.col("other").alias("v")))
    return nodes.join(links, "node", "left").join(roots, "node", "left").select("label", "v", "least", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
