"""Byte-level BPE ids of whole texts, by the tokenizers library, each different word encoded once.

The library splits a text into words by a fixed pattern before it merges bytes, and a word's ids don't depend on
its neighbours. So a batch is split into words in numpy, the different words are found by Arrow's dictionary
encoding, and only words not met before go to the tokenizers library. The ids are those of
``encode(text, add_special_tokens=False)``: strings of the vocabulary's added tokens, such as its end mark, become those tokens, unless
``special_as_text`` takes the special ones as ordinary text. Texts that hold such a string go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from auditloom.llm._arrow import ranges

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Endings that the split pattern takes as words of their own after an apostrophe (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class WordEncoder:
    """encode(bytes, offsets) gives (ids, offsets). ``most_words`` bounds the words kept between calls."""

    def __init__(self, path: str, most_words: int = 400_000, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = [t.content.encode() for t in added if t.content and not (special_as_text and t.special)]
        self.most_words = most_words
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(np.arange(128, dtype=np.uint32))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _learn(self, points: np.ndarray) -> None:
        """Ask the library itself for the kind of each code point: which run it continues."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for point in points.tolist():
            c = chr(point)
            kind = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(before + c)) == 1), SPACE)
            self.kinds[point] = kind

    def _points(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kind of each byte's code point, and whether a byte starts a code point."""
        kind = self.kinds[:256][data]
        lead = (data & 0xC0) != 0x80
        high = np.flatnonzero(data >= 0xC0)
        if len(high):
            b = [data[np.minimum(high + k, len(data) - 1)].astype(np.uint32) for k in range(4)]
            low = [x & 0x3F for x in b]
            point = np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | low[1], np.where(b[0] < 0xF0, (b[0] & 0x0F) << 12 | low[1] << 6 | low[2], (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
            new = np.unique(point)
            self._learn(new[self.kinds[new] == UNKNOWN])
            of = self.kinds[point]
            for k in range(4):
                here = (b[0] >= (0, 0xC0, 0xE0, 0xF0)[k]) & (high + k < len(data))
                kind[high[here] + k] = of[here]
        return kind, lead

    def words(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words start, in bytes, over all texts; words never cross texts."""
        n = len(data)
        kind, lead = self._points(data)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first = first[:n]
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        start &= lead
        blank = kind == SPACE
        # Before a word, the last white space is split off its run; if it is U+0020 it joins the word.
        begins = np.flatnonzero(start & ~blank & ~first)
        begins = begins[blank[begins - 1]]
        last = begins - 1
        while len(back := np.flatnonzero(~lead[last])):
            last[back] -= 1
        start[last] = True
        start[begins[data[last] == 0x20]] = False
        # An apostrophe that stands alone, not after U+0020, takes its ending along.
        mark = np.flatnonzero((data == 0x27) & start)
        mark = mark[mark + 1 < n]
        mark = mark[start[mark + 1] & (kind[mark + 1] == LETTER) & ~first[mark + 1]]
        if len(mark):
            ends = np.append(np.flatnonzero(start), n)
            stop = ends[np.searchsorted(ends, mark + 1, "right")]
            for m, e in zip(mark.tolist(), stop.tolist(), strict=True):
                tail = data[m + 1 : min(e, m + 3)].tobytes()
                if size := next((len(x) for x in CONTRACTIONS if tail.startswith(x.encode())), 0):
                    start[m + 1] = False
                    if m + 1 + size < e:
                        start[m + 1 + size] = True
        return np.flatnonzero(start)

    def _index(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most_words:
            self._forget()
        get = self.known.get
        index = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(index < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids, sizes = [], []
            for k in range(0, len(fresh), 4096):
                part = fresh[k : k + 4096]
                got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(got.ids, np.uint32))
                sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
            base, grown = len(self.starts), np.concatenate(sizes)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(grown) - grown])
            self.ids = np.concatenate([self.ids, *ids])
            self.sizes = np.concatenate([self.sizes, grown])
            self.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            index[new] = np.arange(base, base + len(fresh))
        return index

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that hold the string of an added token."""
        raw, found = data.tobytes(), set()
        for mark in self.marks:
            at = raw.find(mark)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(mark) <= offsets[text + 1]:
                    found.add(text)
                    at = raw.find(mark, int(offsets[text + 1]))
                else:
                    at = raw.find(mark, at + 1)
        return sorted(found)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start = self.words(data, offsets)
        at = np.append(start, len(data)).astype(np.int64)
        spans = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
        coded = spans.dictionary_encode()
        index = self._index(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.sizes[index]
        ids = self.ids[ranges(self.starts[index], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, upto[np.searchsorted(start, offsets)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids start."""
        marked = self._marked(data, offsets)
        if not marked:
            return self._plain(data, offsets)
        ids, at, first = [], [np.zeros(1, np.int64)], 0
        for text in [*marked, len(offsets) - 1]:
            if text > first:
                got, ends = self._plain(data[offsets[first] : offsets[text]], offsets[first : text + 1] - offsets[first])
                ids.append(got)
                at.append(at[-1][-1] + ends[1:])
            if text < len(offsets) - 1:
                got = np.array(self.tokenizer.encode(data[offsets[text] : offsets[text + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                ids.append(got)
                at.append(at[-1][-1:] + len(got))
            first = text + 1
        return np.concatenate(ids), np.concatenate(at)
