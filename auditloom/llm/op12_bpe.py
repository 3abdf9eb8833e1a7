"""Byte-level BPE encoding and decoding of whole texts by a rank file, over overlapping chunks.

A text is cut into chunks of about ``chunk`` bytes that each run ``overlap`` bytes into the next one, and every chunk is
pre-tokenised by itself. The public split pattern looks ahead but never behind, so where two neighbouring chunks
have a boundary at the same place, both go on alike: the seam is stitched at the first such place. A chunk's boundaries
within ``LOOK`` bytes of its end aren't trusted, as the pattern may have looked further. Where an overlap holds
no common boundary, as inside a run of letters longer than it, what follows the last trusted boundary is
pre-tokenised again together with the next chunk, each time after it has doubled, which stays linear. The stitched pieces
are then encoded; decoding joins the tokens' bytes.

Texts of at most ``long_bytes`` are cut, stitched and encoded where they are read, without a shuffle. Longer ones
become rows of a chunk each that are dealt over the tasks to be pre-tokenised, stream through a task a document to be
stitched, and are dealt anew as pieces to be encoded; no task holds more than two chunks and one pre-token. Hence a very long
document is spread over the executors, and a lost one costs a reread of the saved chunks.

Kinds of code points are asked from the encoding library itself, since other regex engines know other versions of
Unicode; a different word is encoded once a task.

Defined cases: a null text counts as empty and has no tokens; an empty text likewise; a null or repeated id is carried
through, each row being a document of its own; a table without rows gives none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import CACHES, flat_bytes, lean, ranges, slices
from auditloom.llm._store import save
from auditloom.llm.bytebpe import LETTER, NUMBER, OTHER, SPACE, WordEncoder

CHUNK, OVERLAP, LONG = 1 << 16, 1 << 10, 1 << 20
#: How far before its end a chunk's boundaries aren't trusted: a white space and the character after it take 8 bytes at most.
LOOK = 8
#: Most bytes of text that are encoded at once.
SLICE = 4 << 20
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ENCODERS: dict = CACHES.setdefault(__name__, {})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, file)))}


class RankEncoder(WordEncoder):
    """Words by the public split pattern, their ids by the ranks, and the bytes of ids."""

    def __init__(self, path: str, most_words: int = 400_000):
        import public_tokenizers
        import tiktoken

        self.pattern, ranks = public_tokenizers.PATTERN, read_ranks(path)
        self.library = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = SimpleNamespace(encode=self._encode_words)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.marks, self.most_words = [], most_words
        self.kinds = np.full(0x110000, 255, np.uint8)
        self._learn(np.arange(128, dtype=np.uint32))
        self._forget()

    def _encode_words(self, words: list[str], **_) -> SimpleNamespace:
        ids, of = [], []
        for k, w in enumerate(words):
            got = self.library._encode_single_piece(w)
            ids += got
            of += [k] * len(got)
        return SimpleNamespace(ids=ids, word_ids=of)

    def _learn(self, points: np.ndarray) -> None:
        """The kind of each code point, from whether the library takes it into the run of another: such a pair is a token of an encoding made for that."""
        import tiktoken

        if not len(points):
            return
        before = ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
        ranks = {bytes([b]): b for b in range(256)}
        for c in map(chr, points.tolist()):
            for _, start in before:
                ranks.setdefault((start + c).encode(), len(ranks))
        library = tiktoken.Encoding("kinds", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        for point in points.tolist():
            self.kinds[point] = next((kind for kind, start in before if len(library.encode_ordinary(start + chr(point))) == 1), SPACE)

    def ids_of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that start at ``starts``, one after the other, and where each word's ids start."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        at = np.append(starts, len(data)).astype(np.int64)
        spans = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
        coded = spans.dictionary_encode()
        index = self._index(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.sizes[index]
        return self.ids[ranges(self.starts[index], sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of ids."""
        return self.token_bytes[ranges(self.token_starts[ids], self.token_sizes[ids])]


def encoder(path: str) -> RankEncoder:
    """One encoder a Python worker, so that words met in one task are known in the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RankEncoder(path)
    return _ENCODERS[path]


def chunk_bounds(data: np.ndarray, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of a text's chunks; both stand between code points."""

    def aligned(at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    out, start = [], 0
    while len(data) - start > chunk + overlap and (end := aligned((after := aligned(start + chunk)) + overlap)) < len(data):
        out.append((start, end))
        start = after
    return [*out, (start, len(data))]


class Stitcher:
    """Takes a text's chunks in order and gives its pieces: (where it starts, its bytes, word starts in the text)."""

    def __init__(self, words) -> None:
        self.words = words
        self.data: np.ndarray | None = None

    def _scan(self) -> None:
        self.data, self.parts = np.concatenate([self.data, *self.parts]), []
        self.scanned = len(self.data)
        self.bounds = self._trusted(self.at, self.data, self.at + self.words(self.data, np.array([0, len(self.data)])))

    def _trusted(self, at: int, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return bounds if self.last else bounds[bounds <= at + len(data) - LOOK]

    def _cut(self, upto: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """The piece before ``upto``."""
        if upto == self.since:
            return []
        piece = self.since, self.data[self.since - self.at : upto - self.at], self.bounds[(self.bounds >= self.since) & (self.bounds < upto)]
        self.since = upto
        return [piece]

    def add(self, at: int, data: np.ndarray, bounds: np.ndarray, last: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
        self.last = last
        bounds, out = self._trusted(at, data, bounds), []
        if self.data is None:
            self.at, self.since, self.data, self.bounds, self.parts, self.scanned = at, at, data, bounds, [], len(data)
        else:
            held = self.bounds
            if self.parts:
                held = held[:0]
            common = np.intersect1d(held[held >= at], bounds, assume_unique=True)
            if not len(common):
                # Nothing in common: the last trusted word is open and goes on into this chunk.
                if not self.parts:
                    out += self._cut(int(self.bounds[-1]) if len(self.bounds) else self.since)
                    self.data = self.data[self.since - self.at :]
                    self.at = self.since
                end = self.at + len(self.data) + sum(map(len, self.parts))
                self.parts.append(data[end - at :])
                if last or len(self.data) + sum(map(len, self.parts)) >= 2 * self.scanned:
                    self._scan()
                    common = np.intersect1d(self.bounds[self.bounds >= at], bounds, assume_unique=True)
            if len(common):
                out += self._cut(int(common[0]))
                self.at, self.data, self.bounds, self.scanned = at, data, bounds, len(data)
        if last:
            out += self._cut(self.at + len(self.data))
        return out


def _word_starts(words: RankEncoder, data: np.ndarray, offsets: np.ndarray, chunk: int, overlap: int) -> np.ndarray:
    """Where the words of all texts start: chunks pre-tokenised each by itself, all at once, then stitched text by text."""
    cuts = [(t, a, b) for t, o in enumerate(offsets[:-1].tolist()) for a, b in chunk_bounds(data[o : offsets[t + 1]], chunk, overlap) if b > a]
    if not cuts:
        return np.zeros(0, np.int64)
    text, a, b = (np.array(x, np.int64) for x in zip(*cuts, strict=True))
    at = np.concatenate([[0], np.cumsum(b - a)])
    parts = data[ranges(offsets[text] + a, b - a)]
    found = words.words(parts, at)
    of = np.searchsorted(at, found, "right") - 1
    found = found - at[of] + a[of]
    edge = np.searchsorted(of, np.arange(len(a) + 1))
    many = np.bincount(text, minlength=len(offsets) - 1) > 1
    alone = ~many[text[of]]
    out = [found[alone] + offsets[text[of[alone]]]]
    for t in np.flatnonzero(many).tolist():
        stitcher = Stitcher(words.words)
        mine = np.flatnonzero(text == t)
        for c in mine.tolist():
            for _, _, starts in stitcher.add(int(a[c]), parts[at[c] : at[c + 1]], found[edge[c] : edge[c + 1]], c == mine[-1]):
                out.append(starts + offsets[t])
    return np.sort(np.concatenate(out))


def _pieces(path: str, docs: DataFrame, chunk: int, overlap: int, long_bytes: int, digests: bool) -> DataFrame:
    """(doc, n, ids, ids_sha256, decoded_sha256) of ordinary texts, and (doc, row, k, at, last, part) of long ones, a row a chunk."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, row = encoder(path), TaskContext.get().partitionId() << 40
        names = ["doc", "row", "k", "at", "last", "part", "n", "ids", "ids_sha256", "decoded_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.string()]
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                data, offsets = flat_bytes(batch.column(1))
                docs_of, rows = batch.column(0).to_pylist(), []
                long = np.diff(offsets) > long_bytes
                for t in np.flatnonzero(long).tolist():
                    text = data[offsets[t] : offsets[t + 1]]
                    for k, (a, b) in enumerate(chunk_bounds(text, chunk, overlap)):
                        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((docs_of[t], row, k, a, b == len(text), text[a:b].tobytes(), None, None, None, None), kinds, strict=True)], names=names)
                    row += 1
                if long.any():
                    short = np.where(long, 0, np.diff(offsets))
                    data, offsets = data[ranges(offsets[:-1], short)], np.concatenate([[0], np.cumsum(short)])
                starts = _word_starts(words, data, offsets, chunk, overlap)
                ids, upto = words.ids_of(data, starts)
                upto = upto[np.searchsorted(starts, offsets)]
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B") if len(ids) else b""
                for t in np.flatnonzero(~long).tolist():
                    a, b = int(upto[t]), int(upto[t + 1])
                    if digests:
                        rows.append((docs_of[t], None, None, None, None, None, b - a, None, hashlib.sha256(raw[4 * a : 4 * b]).hexdigest(), hashlib.sha256(words.decode(ids[a:b])).hexdigest()))
                    else:
                        rows.append((docs_of[t], None, None, None, None, None, b - a, bytes(raw[4 * a : 4 * b]), None, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.mapInArrow(run, "doc long, row long, k long, at long, last boolean, part binary, n long, ids binary, ids_sha256 string, decoded_sha256 string")


def _long_pieces(path: str, chunks: DataFrame) -> DataFrame:
    """(row, doc, k, last, ids) of long texts' stitched pieces: chunks and then pieces are dealt over all tasks."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            parts = [np.frombuffer(p.as_buffer(), np.uint8) for p in batch.column("part")]
            bounds = [words.words(p, np.array([0, len(p)])).astype("<i8").tobytes() for p in parts]
            yield batch.append_column("bounds", pa.array(bounds, pa.binary()))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stitcher, k = encoder(path), None, 0
        for batch in batches:
            for doc, row, at, last, part, bounds in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "at", "last", "part", "bounds")), strict=True):
                if stitcher is None:
                    stitcher, k = Stitcher(words.words), 0
                pieces = stitcher.add(at, np.frombuffer(part, np.uint8), at + np.frombuffer(bounds, "<i8"), last)
                for n, (since, piece, starts) in enumerate(pieces):
                    out = (doc, row, k, last and n == len(pieces) - 1, piece.tobytes(), (starts - since).astype("<i8").tobytes())
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc", "row", "k", "last", "part", "bounds"), out, strict=True))], schema)
                    k += 1
                stitcher = None if last else stitcher

    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("k", pa.int64()), ("last", pa.bool_()), ("part", pa.binary()), ("bounds", pa.binary())])

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            ids = [words.ids_of(np.frombuffer(p.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), "<i8"))[0].astype("<u4").tobytes() for p, b in zip(batch.column("part"), batch.column("bounds"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "row", "k", "last")), pa.array(ids, pa.binary())], names=["doc", "row", "k", "last", "ids"])

    parts = "doc long, row long, k long, last boolean, part binary, bounds binary"
    scanned = chunks.select("doc", "row", "k", "at", "last", "part").repartition("row", "k").mapInArrow(scan, "doc long, row long, k long, at long, last boolean, part binary, bounds binary")
    stitched = scanned.repartition("row").sortWithinPartitions("row", "k").mapInArrow(stitch, parts)
    return stitched.repartition("row", "k").mapInArrow(encode, "doc long, row long, k long, last boolean, ids binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, long_bytes: int = LONG) -> DataFrame:
    """(doc_id, row, piece, last, ids): ids as little-endian 32-bit numbers. Long texts have several pieces of one ``row``; others have a null one."""
    made = save(_pieces(ranks_path, _texts(docs, id_col, text_col), chunk, overlap, long_bytes, False), "encoded")
    short = made.filter("part is null").select("doc", "row", F.lit(0).cast("long").alias("k"), F.lit(True).alias("last"), "ids")
    return short.unionByName(_long_pieces(ranks_path, made.filter("part is not null"))).toDF("doc_id", "row", "piece", "last", "ids")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``bytes``, the raw bytes of their ids joined. Only all pieces of a text together are sure to be UTF-8; null ids give null."""
    names = encoded.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(ranks_path)
        for batch in batches:
            raw = [words.decode(np.frombuffer(x.as_buffer(), "<u4")).tobytes() if x.is_valid else None for x in batch.column(names.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "bytes"])

    return encoded.mapInArrow(run, encoded.withColumn("bytes", F.lit(None).cast("binary")).schema)


def codec_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, long_bytes: int = LONG) -> DataFrame:
    """A row a document: number of ids, and digests of the ids and of what they decode to. Pieces of long texts stream through in order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, ids, raw = encoder(ranks_path), 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for doc, last, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                got = np.frombuffer(piece.as_buffer(), "<u4")
                n += len(got)
                ids.update(got)
                raw.update(words.decode(got))
                if last:
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "n_tokens": n, "ids_sha256": ids.hexdigest(), "decoded_sha256": raw.hexdigest()}], schema)
                    n, ids, raw = 0, hashlib.sha256(), hashlib.sha256()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    made = save(_pieces(ranks_path, _texts(docs, id_col, text_col), chunk, overlap, long_bytes, True), "encoded")
    short = made.filter("part is null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_tokens"), "ids_sha256", "decoded_sha256")
    long = _long_pieces(ranks_path, made.filter("part is not null")).repartition("row").sortWithinPartitions("row", "k")
    return short.unionByName(long.mapInArrow(run, DIGESTS))
