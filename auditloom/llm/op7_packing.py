"""Packing of token streams into fixed windows by order-preserving dynamic programming.

Documents keep their order. The stream of a task's documents is cut into windows of at most ``window`` tokens;
a cut may fall at the end of a document (free), at the end of a sentence (``sentence_cost``) or, where sentences are
long, on a grid of every ``grid`` tokens (``forced_cost``). The cuts minimise padding plus these truncation
penalties:

    best[j] = cost[j] + window + min over i, p[j] - p[i] <= window, of best[i] - (p[j] - p[i])

``best[i] + p[i]`` doesn't depend on j, so the minimum over the sliding range of i comes from a monotone queue and the
whole programme is linear in the number of possible cuts. It is run over chunks of about ``chunk`` tokens; the last
two windows of a chunk are taken back into the next one, so memory doesn't grow with the partition. What remains
at a task's end is stored as windows whose lengths are powers of two, which need no padding, if that costs less.

There is no shuffle: windows are made where the documents are read. Sequence ids are the partition's number times
2**40 plus a counter, so a task that is run again gives the same rows.

Defined cases: a null text counts as empty and gives the end id alone; a null or repeated id is carried through, each
row being a document of its own; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import CACHES, flat_bytes, lean, slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 0
#: Most bytes of text that are tokenised at once.
SLICE = 4 << 20
_ENCODERS: dict = CACHES.setdefault(__name__, {})


def encoder(path: str):
    """One encoder a Python worker, so that words met in one task are known in the next."""
    from auditloom.llm.bytebpe import WordEncoder

    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def choose_cuts(points: np.ndarray, costs: np.ndarray, window: int, open_end: bool, extra: int = 8) -> np.ndarray:
    """Cuts of least padding plus penalties among ``points`` (rising, from 0 to the end, no gap over ``window``).

    If the end is not open, the last stretch may be stored as windows of powers of two, each at a cost of ``extra``.
    """
    p, c = points.tolist(), costs.tolist()
    n = len(p)
    best, back = [0] * n, [0] * n
    queue: deque = deque([0])
    level = [0] * n  # best + p
    for j in range(1, n):
        pj = p[j]
        low = pj - window
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best[j] = value = level[i] + window - pj + c[j]
        back[j] = i
        level[j] = value = value + pj
        while queue and level[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    last = n - 1
    if not open_end and n > 1:
        i = last - 1
        choice = (best[last], back[last])
        while i >= 0 and p[last] - p[i] <= window:
            choice = min(choice, (best[i] + extra * (p[last] - p[i]).bit_count(), i))
            i -= 1
        back[last] = choice[1]
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return np.array([p[i] for i in reversed(cuts)], np.int64)


class Packer:
    """Takes tokenised documents, gives rows of SCHEMA."""

    def __init__(self, first: int, ends_sentence: np.ndarray, window: int, chunk: int, sentence_cost: int, forced_cost: int, grid: int):
        self.next, self.ends_sentence, self.window, self.chunk = first, ends_sentence, window, chunk
        self.sentence_cost, self.forced_cost, self.grid = sentence_cost, forced_cost, grid
        self.ids = np.zeros(0, np.uint32)
        #: Of the documents in ``ids``: id, tokens, and where the first one's stored part begins.
        self.docs: list = []
        self.sizes = np.zeros(0, np.int64)
        self.skip = 0

    def add(self, docs: list, sizes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs += docs
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        if len(self.ids) >= self.chunk:
            yield self._pack(False)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if len(self.ids):
            yield self._pack(True)

    def _points(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cost = np.full(len(self.ids) + 1, -1, np.int32)
        cost[np.flatnonzero(self.ends_sentence[self.ids]) + 1] = self.sentence_cost
        cost[ends] = 0
        cost[0] = 0
        points = np.flatnonzero(cost >= 0)
        wide = np.flatnonzero(np.diff(points) > self.grid * 2)
        for a, b in zip(points[wide].tolist(), points[wide + 1].tolist(), strict=True):
            cost[a + self.grid : b : self.grid] = self.forced_cost
        points = np.flatnonzero(cost >= 0)
        return points, cost[points]

    def _pack(self, last: bool) -> pa.RecordBatch:
        ends = np.cumsum(self.sizes) - self.skip
        cuts = choose_cuts(*self._points(ends), self.window, not last)
        if not last:
            cuts = cuts[: max(2, len(cuts) - 2)]
        elif (rest := int(cuts[-1] - cuts[-2])) < self.window and 8 * rest.bit_count() < self.window - rest:
            parts = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
            cuts = np.concatenate([cuts[:-1], cuts[-2] + np.cumsum(parts)])
        upto = int(cuts[-1])
        edges = np.unique(np.concatenate([cuts, ends[ends < upto]]))
        start, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, start, "right")
        seq = np.searchsorted(cuts, start, "right") - 1
        view = memoryview(self.ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        begins = ends - self.sizes
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.docs[i] for i in doc.tolist()], pa.int64()), *map(pa.array, (start - begins[doc], stop - start)), pa.array(crc, pa.int64()), pa.array(self.sizes[doc]), pa.array(self.next + seq), pa.array(start - cuts[seq])],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.next += len(cuts) - 1
        done = int(np.searchsorted(ends, upto, "right"))
        self.skip = upto - int(begins[done]) if done < len(ends) else 0
        self.ids, self.docs, self.sizes = self.ids[upto:].copy(), self.docs[done:], self.sizes[done:]
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1_000_000, sentence_cost: int = 2, forced_cost: int = 6, grid: int = 16) -> DataFrame:
    """A row for each piece: ids ``start`` to ``start + length`` of a document's ids stand at ``offset`` of a sequence."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(tokenizer_path)
        size = words.tokenizer.get_vocab_size()
        ends_sentence = np.zeros(size, bool)
        for token in range(size):
            text = words.tokenizer.id_to_token(token) or ""
            ends_sentence[token] = text.endswith((".", "!", "?")) or "Ċ" in text  # U+010A stands for a line feed
        packer = Packer(TaskContext.get().partitionId() << 40, ends_sentence, window, chunk, sentence_cost, forced_cost, grid)
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                data, offsets = flat_bytes(batch.column(1))
                ids, at = words.encode(data, offsets)
                sizes = np.diff(at)
                ended = np.insert(ids, at[1:], END_ID).astype(np.uint32, copy=False)
                yield from packer.add(batch.column(0).to_pylist(), sizes + 1, ended)
        yield from packer.finish()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCHEMA)
