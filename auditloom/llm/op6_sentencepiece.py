"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read by hand (wire format: field number and type, then value). From it the normaliser (character map, extra
white space, dummy prefix), the white-space marker U+2581, the pieces with their scores and the byte fallback are rebuilt: a unigram model
from its scores, a BPE model from merges ranked by the score of what they give.

No piece of a usual model holds the marker after another character, so pieces never span the start of a run of markers. A text is
therefore cut there into units; only units not met before go to the library, in multithreaded batches, and ids are put together in
numpy. If a model has such a piece, whole texts are encoded instead. Decoding works unit by unit too.

``verify`` encodes each whole text with the sentencepiece library as well and reports whether the ids are the same. Two cuts of one unit into the
same pieces in another order ("c cc", "cc c") have equal scores; that library adds them in single precision, this one in double, so where
rounding tells such cuts apart they may choose differently, which ``parity`` then shows.

Defined cases: a null text counts as empty and has no ids; null or repeated ids are carried, each row for itself; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import CACHES, flat_bytes, lean, ranges, slices

MARK = "▁"
#: Piece types and model types of the format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < n:
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


class Model:
    """What the model file says."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        with open(path, "rb") as file:
            whole = file.read()
        for number, value in fields(whole):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap: bytes = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.remove_extra = bool(normalizer.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, by falling score of what they make."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL and len(piece) > 1:
                for k in range(1, len(piece)):
                    left, right = piece[:k], piece[k:]
                    if left in ids and right in ids:
                        found.append((-score, ids[left], ids[right], left, right))
        return [(left, right) for *_, left, right in sorted(found)]

    def cuttable(self) -> bool:
        """Whether no piece holds the marker after another character."""
        return not any(kind in (NORMAL, USER) and MARK in p.lstrip(MARK) for p, _, kind in self.pieces)


def build(model: Model):
    """The tokenizers library's tokenizer over normalised text (markers in place of spaces)."""
    from tokenizers import Tokenizer, decoders, models

    unknown = model.pieces[model.unknown][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, *_) in enumerate(model.pieces)}, model.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind}: neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


def normaliser(model: Model):
    """The model's normaliser as a function of text: character map, extra spaces, and markers as spaces."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    chain = normalizers.Sequence(steps) if steps else None

    def normalise(text: str) -> str:
        text = (chain.normalize_str(text) if chain else text).replace(MARK, " ")
        return " " + text if text and model.dummy_prefix else text

    return normalise


class Codec:
    """encode_texts and decode; ``most_units`` bounds the units kept between calls."""

    def __init__(self, path: str, most_units: int = 1_000_000):
        self.model = Model(path)
        self.tokenizer = build(self.model)
        self.normalise = normaliser(self.model)
        self.cut = self.model.cuttable()
        self.most_units = most_units
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.true = np.zeros(0, bool)

    def _index(self, units: list[str]) -> np.ndarray:
        if len(self.known) > self.most_units:
            self._forget()
        index = np.fromiter((self.known.get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(index < 0)
        if len(new):
            fresh = [units[i] for i in new.tolist()]
            got = [e.ids for e in self.tokenizer.encode_batch([u.replace(" ", MARK) for u in fresh], add_special_tokens=False)]
            back = self.tokenizer.decode_batch(got, skip_special_tokens=False)
            sizes = np.array([len(x) for x in got], np.int64)
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], np.uint32)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.true = np.concatenate([self.true, np.array([a == b for a, b in zip(fresh, back, strict=True)], bool)])
            self.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            index[new] = np.arange(base, base + len(fresh))
        return index

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin, whether each decodes to its normalised text)."""
        data, at = flat_bytes(pa.array([self.normalise(t) for t in texts], pa.large_string()))
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool)
        start = np.zeros(len(data) + 1, bool)
        start[at] = True
        start = start[:-1]
        if self.cut:
            blank = data == 0x20
            start |= blank & ~np.concatenate([[False], blank[:-1]])
        begins = np.flatnonzero(start)
        spans = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = spans.dictionary_encode()
        index = self._index(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        upto = np.concatenate([[0], np.cumsum(self.sizes[index])])
        wrong = np.concatenate([[0], np.cumsum(~self.true[index])])
        unit = np.searchsorted(begins, at)
        return self.ids[ranges(self.starts[index], self.sizes[index])], upto[unit], np.diff(wrong[unit]) == 0

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without the dummy prefix."""
        text = self.tokenizer.decode([int(i) for i in ids], skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_CODECS: dict[str, Codec] = CACHES.setdefault(__name__, {})


def codec(path: str) -> Codec:
    """One codec a Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True, ids: bool = False, threads: int = 2) -> DataFrame:
    """A row a document: how many ids, their CRC-32 (little-endian 32-bit), whether decoding gives the text, whether sentencepiece agrees."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        mine = codec(model_path)
        reference = None
        if verify:
            import sentencepiece

            reference = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for whole in batches:
            for batch in slices(whole, "t", 4 << 20):
                texts = batch.column(1).fill_null("").to_pylist()
                all_ids, at, true = mine.encode_texts(texts)
                view = memoryview(all_ids.astype("<u4", copy=False)).cast("B")
                parts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                parity = [None] * len(texts)
                if reference:
                    parity = [np.array_equal(all_ids[a:b], np.array(x, np.uint32)) for (a, b), x in zip(parts, reference.encode(texts, num_threads=1), strict=True)]
                columns = [batch.column(0), pa.array(np.diff(at)), pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in parts], pa.int64()), pa.array(true), pa.array(parity, pa.bool_())]
                names = ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(all_ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of ids."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mine.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("i"), F.col(ids_col).alias("x")).mapInArrow(run, "doc_id long, text string")
