r"""Importance resampling towards a target distribution, with hashed n-gram features counted in word tries.

Features are the runs of one to three consecutive words of a text. Each task grows a trie of words over its partition: a
node stands for a feature and holds how often it occurred and its CRC-32 state, so that a child's state follows from its
parent's and the new word's (one table lookup a byte of the state: appending a word is linear over GF(2)). Counts of a trie's
nodes are summed to buckets, buckets over tasks: ``buckets`` rows a task are shuffled, whatever the text. The same is done
for the target's texts. From both totals comes a gain for each bucket, ``buckets`` numbers that go out to the tasks, and a second
walk scores the texts: nodes hold the gains summed along their path, so each word adds what its deepest node holds.

A trie that holds more than ``most_nodes`` gives its counts to the totals and starts anew, so memory is bounded and
nothing is dropped. A long text is walked in parts that reach two words into the next one. Words are numbered and nodes found in
numpy, a slice of texts at a time.

The draw takes the highest of weight plus Gumbel noise, which samples without replacement in proportion to the exponent of the
weight; noise comes from a digest of the id. Ranks are global: rows are dealt by ranges of the score and numbered from partition counts.

Defined cases: a null or empty text has no features and weight 0; a null id counts as the empty string where it is hashed and comes
last among ties; a repeated id is a row of its own with the same noise; without target texts all t are 0; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import flat_bytes, lean, slices
from auditloom.llm._store import drop, save
from auditloom.operators.rank import ranked

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
MOST_NODES = 3 << 20
#: Most bytes of text that are walked at once.
SLICE = 2 << 20
#: Appended strings up to this length are taken from tables; longer ones are fed to CRC-32 byte by byte.
TABLES = 48
_WORD, _GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _shift_tables(most: int) -> np.ndarray:
    """[n, k, b]: what byte b at place k of a CRC-32 state becomes when n bytes are appended."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)  # the polynomial of CRC-32
    state = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [state]
    for _ in range(most):
        state = (state >> np.uint32(8)) ^ step[state & 0xFF]
        out.append(state)
    return np.stack(out)


_SHIFT = _shift_tables(TABLES)


class WordTrie:
    """Nodes of one, two and three words; with ``gains`` (one a bucket) they hold the gains summed along their path, without they count."""

    def __init__(self, buckets: int, gains: np.ndarray | None = None, most_nodes: int = MOST_NODES):
        self.buckets, self.gains, self.most_nodes = buckets, gains, most_nodes
        self.totals = np.zeros(buckets, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.spelt: list[bytes] = []
        self.spaced, self.width = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        #: By level: keys (parent, word) in order, the node of each, and by node its state and its count or gain.
        self.keys = [np.zeros(0, np.int64) for _ in range(2)]
        self.nodes = [np.zeros(0, np.int64) for _ in range(2)]
        self.crc = [np.zeros(0, np.uint32) for _ in range(3)]
        self.held = [np.zeros(0, np.int64) for _ in range(3)]

    def flush(self) -> None:
        """Counts go to the bucket totals; the trie is empty then."""
        if self.gains is None:
            for crc, held in zip(self.crc, self.held, strict=True):
                np.add.at(self.totals, crc % self.buckets, held)
        self._clear()

    def _grow(self, level: int, crc: np.ndarray, parent: np.ndarray | None) -> None:
        fresh = np.zeros(len(crc), np.int64)
        if self.gains is not None:
            fresh = self.gains[crc % self.buckets]
            if parent is not None:
                fresh = fresh + self.held[level - 1][parent]
        self.crc[level] = np.concatenate([self.crc[level], crc])
        self.held[level] = np.concatenate([self.held[level], fresh])

    def number(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of words, which are the nodes below the root. data: the words' bytes without gaps."""
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words, get = spelt.dictionary.to_pylist(), self.words.get
        index = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(index < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            index[new] = np.arange(len(self.words), len(self.words) + len(fresh))
            self.words.update(zip(fresh, index[new].tolist(), strict=True))
            self.spelt += fresh
            self.spaced = np.concatenate([self.spaced, np.array([zlib.crc32(b" " + w) for w in fresh], np.uint32)])
            self.width = np.concatenate([self.width, np.array([len(w) + 1 for w in fresh], np.int64)])
            self._grow(0, np.array([zlib.crc32(w) for w in fresh], np.uint32), None)
        return index[spelt.indices.to_numpy()]

    def _append(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """CRC-32 of each state's string with a space and the word after it."""
        n = np.minimum(self.width[word], TABLES)
        out = self.spaced[word]
        for k in range(4):
            out = out ^ _SHIFT[n, k, (state >> np.uint32(8 * k)) & 0xFF]
        for i in np.flatnonzero(self.width[word] > TABLES).tolist():
            out[i] = zlib.crc32(b" " + self.spelt[word[i]], int(state[i]))
        return out

    def _child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes of (parent, word); those not met before are made."""
        coded = pa.array(parent << 32 | word).dictionary_encode()
        wanted = coded.dictionary.to_numpy()
        order = np.argsort(wanted, kind="stable")
        wanted = wanted[order]
        keys, nodes = self.keys[level - 1], self.nodes[level - 1]
        at = np.searchsorted(keys, wanted)
        new = np.ones(len(wanted), bool)
        inside = at < len(keys)
        new[inside] = keys[at[inside]] != wanted[inside]
        if new.any():
            fresh = wanted[new]
            first = len(keys)
            self._grow(level, self._append(self.crc[level - 1][fresh >> 32], fresh & 0xFFFFFFFF), fresh >> 32)
            self.keys[level - 1] = keys = np.insert(keys, at[new], fresh)
            self.nodes[level - 1] = nodes = np.insert(nodes, at[new], np.arange(first, first + len(fresh)))
            at = np.searchsorted(keys, wanted)
        node = np.empty(len(order), np.int64)
        node[order] = nodes[at]
        return node[coded.indices.to_numpy()]

    def walk(self, data: np.ndarray, sizes: np.ndarray, part: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """The gain of each word's path: features that start at it. Words of other parts don't follow it; where it isn't ``counted``, nothing starts."""
        if sum(map(len, self.crc)) > self.most_nodes:
            self.flush()
        word = self.number(data, sizes)
        gain = np.zeros(len(word), np.int64)
        at, node = np.flatnonzero(counted), word[counted]
        for level in range(3):
            if level:
                goes = at + level < len(part)
                goes[goes] = part[at[goes] + level] == part[at[goes]]
                at, node = at[goes], self._child(level, node[goes], word[at[goes] + level])
            if self.gains is None:
                self.held[level] += np.bincount(node, minlength=len(self.held[level]))
            else:
                gain[at] = self.held[level][node]
        return gain


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, counted, text) of texts, or of parts of a single long one: ``counted`` bytes, then the two words that follow."""
    if len(offsets) > 2 or len(data) <= most:
        yield data, offsets, np.diff(offsets), np.arange(len(offsets) - 1)
        return
    raw, start = memoryview(data), 0
    while start < len(data):
        gap = _GAP.search(raw, min(start + most, len(data)))
        stop = end = gap.start() if gap else len(data)
        for word, _ in zip(_WORD.finditer(raw, stop), range(2), strict=False):
            end = word.end()
        yield data[start:end], np.array([0, end - start]), np.array([stop - start]), np.zeros(1, np.int64)
        start = stop


def _walk(trie: WordTrie, column: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, features, gain) of each text."""
    data, offsets = flat_bytes(column)
    out = np.zeros((3, len(offsets) - 1), np.int64)
    for part, at, counted, text in _parts(data, offsets, most):
        low = _LOWER[part]
        inside = _IN_WORD[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[at] = True
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        if not len(starts):
            continue
        owner = np.searchsorted(at, starts, "right") - 1
        sizes = np.add.reduceat(inside.astype(np.int64), starts)
        mine = starts - at[owner] < counted[owner]
        gain = trie.walk(low[inside], sizes, owner, mine)
        follows = np.searchsorted(owner, owner, "right") - 1 - np.arange(len(owner))
        for row, values in enumerate((mine.astype(np.int64), np.where(mine, 1 + np.minimum(follows, 2), 0), gain)):
            np.add.at(out[row], text[owner], values)
    return out[0], out[1], out[2]


def bucket_totals(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most_nodes: int = MOST_NODES, slice_bytes: int = SLICE) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task gives a row a bucket; the sums are ``buckets`` rows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(buckets, most_nodes=most_nodes)
        for whole in batches:
            for batch in slices(whole, "t", slice_bytes):
                _walk(trie, batch.column(0), slice_bytes)
        trie.flush()
        full = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(trie.totals[full])], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(buckets, np.int64)
    totals[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return totals


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source, smoothed by one, rounded down."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def text_weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most_nodes: int = MOST_NODES, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, n_words, n_features, weight): a narrow pass over the texts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(len(gains), gains, most_nodes)
        for whole in batches:
            for batch in slices(whole, "t", slice_bytes):
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _walk(trie, batch.column(1), slice_bytes))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from 32 bits of a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, most_nodes: int = MOST_NODES, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` in a hundred of the texts of ``least_words`` words or more get a rank, the highest score first."""
    gains = bucket_gains(bucket_totals(docs, text_col, buckets, most_nodes, slice_bytes), bucket_totals(target, target_col, buckets, most_nodes, slice_bytes))
    weights = text_weights(docs, gains, id_col, text_col, most_nodes, slice_bytes)
    scored = save(weights.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") < least_words).alias("short")), "scored")
    drawn = scored.filter(~F.col("short")).count() * percent // 100
    placed = ranked(scored, "short", F.desc("score"), F.col("doc_id").asc_nulls_last(), name="position")
    drop(scored)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("position") <= drawn, F.col("position")).alias("rank"))


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn."""
    return docs.join(ranks.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_semi")
