"""Token estimates, limits, gates and chunks."""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections import Counter as Counts
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import constants as K

#: A batch of texts to the number of tokens of each.
Counter = Callable[[list[str]], Sequence[int]]


def estimate(content: Column, count: Counter | None = None) -> Column:
    """Tokens of a text: what ``count`` says, a tokenizer's count of each text of a batch; without one a quarter of the characters, rounded up.

    ``count`` runs on the workers over Arrow batches. Null stays null.
    """
    if count is None:
        return F.ceil(F.length(content) / 4.0).cast("long")

    def counted(texts: pd.Series) -> pd.Series:
        counts = iter(count([t for t in texts if t is not None]))
        return pd.Series([None if t is None else int(next(counts)) for t in texts], dtype="Int64")

    counted.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(counted, "long")(content)


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens, read once a worker: a line is a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """A word's tokens: of all neighbours, the pair of least rank is joined, the leftmost of equal ones, until none has a rank.

    Pairs wait in a heap; an entry counts only while both its parts are as they were, so the work grows as n log n with the word.
    """
    ends = list(range(1, len(word) + 1))  # of the part that starts at each byte; 0 once it was joined to the one before
    starts = list(range(-1, len(word) - 1))  # where the part before begins
    heap = [(rank, i, i + 2) for i in range(len(word) - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= len(word) or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, 0
        if end < len(word):
            starts[end] = i
            if (rank := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (rank, i, ends[end]))
        if i and (rank := ranks.get(word[starts[i] : end])) is not None:
            heapq.heappush(heap, (rank, starts[i], end))
    return [word[i:end] for i, end in enumerate(ends) if end]


class RankCounter:
    """A counter for ``estimate``: exact numbers of byte-pair tokens by a rank file, words split by ``pattern`` first.

    It travels to the workers as a path and a pattern. A different word is merged once a worker; ``most_words`` bounds those kept.
    """

    def __init__(self, path: str, pattern: str, most_words: int = 500_000):
        self.path, self.pattern, self.most_words = path, pattern, most_words
        self._sizes: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sizes": {}}

    def __call__(self, texts: list[str]) -> list[int]:
        import regex

        ranks, find = _ranks(self.path), regex.compile(self.pattern).findall
        out = []
        for text in texts:
            words = Counts(find(text))
            # Not the difference of both keys(): it walks all words known so far, for each text anew.
            for word in itertools.filterfalse(self._sizes.__contains__, words):
                raw = word.encode()
                self._sizes[word] = 1 if raw in ranks else len(merged(raw, ranks))
            out.append(sum(n * self._sizes[word] for word, n in words.items()))
            if len(self._sizes) > self.most_words:
                self._sizes.clear()
        return out


def limit(provider: Column, override: Column | None = None) -> Column:
    """A positive override, else the provider's limit in any case, else the default."""
    known = F.lit(K.DEFAULT_TOKEN_LIMIT)
    for name, value in K.TOKEN_LIMITS.items():
        known = F.when(F.lower(provider) == name, value).otherwise(known)
    return F.coalesce(F.when(override > 0, override), known).cast("long") if override is not None else known.cast("long")


def gate(total: Column, most: Column) -> Column:
    """exceeded at the limit or over it, warn from 80 % of it on, else ok."""
    return F.when(total >= most, "exceeded").when(total >= F.floor(most * K.WARN_SHARE), "warn").otherwise("ok")


def percent(total: Column, most: Column) -> Column:
    return F.floor(total / most * 100 + 0.5).cast("long")


def top_files(df: DataFrame, tokens: str, tie: str, n: int = 3) -> DataFrame:
    return df.orderBy(F.desc(tokens), tie).limit(n)


def chunk_lines(content: Column, most: int) -> Column:
    """Lines packed greedily into chunks of at most ``most`` characters, each line costing one more; a longer line is a chunk of its own.

    array<string>. Chunks grow as indices of lines; texts are cut once, at the end.
    """
    lines = F.split(content, "\n")
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def step(s: Column, line: Column) -> Column:
        cost = F.length(line) + 1
        flush = (s["size"] + cost > most) & (s["size"] > 0)
        cuts = F.when(flush, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"])
        return F.struct(cuts.alias("cuts"), F.when(flush, cost).otherwise(s["size"] + cost).alias("size"), (s["at"] + 1).alias("at"))

    cuts = F.aggregate(lines, start, step, lambda s: F.concat(F.array(F.lit(0)), s["cuts"], F.array(s["at"])))
    packed = F.transform(F.array(F.struct(lines.alias("lines"), cuts.alias("cuts"))), lambda x: F.transform(F.slice(x["cuts"], F.lit(1), F.size(x["cuts"]) - 1), lambda a, i: F.array_join(F.slice(x["lines"], a + 1, F.get(x["cuts"], i + 1) - a), "\n")))[0]
    return F.when(F.length(content) <= most, F.array(content)).otherwise(packed)
