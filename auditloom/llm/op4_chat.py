r"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as a whole, turn after turn, as

    <|turn|>ROLE<|says|>TEXT</turn>

and encoded once, with offsets. The mask comes from intersecting the sorted spans of the trained turns with the
sorted spans of tokens by binary search. The three markers are added to the tokenizer as atoms, so that no token spans
a turn's edge and the masked tokens cover the trained texts exactly.

Control strings inside roles and texts are escaped reversibly: a backslash is doubled, and ``<|`` and ``</turn>`` get one
after their first character. Removing one backslash before any character undoes it.

Turns are ordered by turn, then role, then text (nulls first), so ties have a fixed order. Rows are dealt by conversation
and sorted within partitions; a task streams through them. A conversation longer than ``most_chars`` is
rendered in parts cut between turns: the markers are atoms, so the parts' ids joined are those of the whole, and memory
stays bounded however long a conversation is.

Defined cases: a null text or role counts as empty; rows without a conversation id form one conversation with a
null id; repeated rows are turns of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import lean

TURN, SAYS, END = "<|turn|>", "<|says|>", "</turn>"
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|").replace(END, "<\\/turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = ("assistant",)) -> tuple[str, np.ndarray]:
    """The formatted text, and the spans of trained texts in it, as rows of (start, end)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, escapes undone."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


def chat_tokenizer(path: str):
    """The tokenizer with the markers as atoms; strings that are special to it are ordinary text."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.add_tokens([AddedToken(x, normalized=False, special=False) for x in (TURN, SAYS, END)])
    return t


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span. Both are sorted; tokens of one character share its offsets."""
    mask = np.zeros(len(offsets) + 1, np.int32)
    if len(spans) and len(offsets):
        low = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
        high = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
        full = low < high
        np.add.at(mask, low[full], 1)
        np.add.at(mask, high[full], -1)
    return np.cumsum(mask[:-1]) > 0


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, escapes undone: runs of masked tokens, in order."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return "".join(unescape(formatted[offsets[a, 0] : offsets[b - 1, 1]]) for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True))


class _Digest:
    """What is read back from the parts of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0

    def add(self, formatted: str, offsets: np.ndarray, mask: np.ndarray) -> None:
        for role, text in read_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        loss = masked_text(formatted, offsets, mask)
        self.loss.update(loss.encode())
        self.loss_chars += len(loss)
        self.chars += len(formatted)
        self.tokens += len(mask)
        self.loss_tokens += int(mask.sum())

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.loss_tokens


def _parts(batches: Iterator[pa.RecordBatch], most_chars: int) -> Iterator[tuple[int | None, list, bool]]:
    """(conversation, turns, whether it ends here), in parts of about most_chars."""
    conv, turns, size, some = None, [], 0, False
    for batch in batches:
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if some and c != conv:
                yield conv, turns, True
                turns, size = [], 0
            elif size > most_chars:
                yield conv, turns, False
                turns, size = [], 0
            conv, some = c, True
            turns.append((role, text))
            size += len(text)
    if some:
        yield conv, turns, True


def format_chats(conversations: DataFrame, tokenizer_path: str, trained: tuple[str, ...] = ("assistant",), most_chars: int = 1 << 20, texts: bool = False) -> DataFrame:
    """A row for each conversation; with ``texts`` its formatted text, ids and mask too (one row a part)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(tokenizer_path)
        digest, rows, group = _Digest(), [], []

        def encode(group: list) -> Iterator[tuple]:
            rendered = [render(turns, trained) for _, turns, _ in group]
            for (conv, _, last), (formatted, spans), e in zip(group, rendered, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                yield conv, last, formatted, e.ids, offsets, loss_mask(offsets, spans)

        def done(group: list) -> pa.RecordBatch:
            nonlocal digest
            rows = []
            for conv, last, formatted, ids, offsets, mask in encode(group):
                if texts:
                    rows.append((conv, formatted, ids, mask.tolist()))
                    continue
                digest.add(formatted, offsets, mask)
                if last:
                    rows.append(digest.row(conv))
                    digest = _Digest()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

        size = 0
        for part in _parts(batches, most_chars):
            group.append(part)
            size += sum(len(t) for _, t in part[1])
            if size > most_chars:
                yield done(group)
                group, size = [], 0
        if group:
            yield done(group)

    schema = "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>" if texts else SCHEMA
    kind = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    names, kinds = zip(*((x.split()[0], kind[x.split()[1]]) for x in schema.split(", ")), strict=True)
    turns = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("n"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return turns.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t").mapInArrow(run, schema)


#: The conversation that the query adds: both turns hold strings that look like markers and escapes.
PROBE = (-7, r"\### Assistant: </turn> ok")


def with_probe(conversations: DataFrame) -> DataFrame:
    conv, text = PROBE
    rows = [(conv, turn, role, text) for turn, role in enumerate(("user", "assistant"))]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
