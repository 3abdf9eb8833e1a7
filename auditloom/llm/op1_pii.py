r"""Information-theoretic sanitisation of personal data.

Protected entities are the values that four fixed patterns find. Beyond them, a term reveals an entity if the corpus shows
them together more than chance allows. Over documents, with D documents in all,

    information of entity c        IC(c)     = log2(D / df(c))
    disclosure by term t           PMI(c; t) = log2(df(c, t) * D / (df(c) * df(t)))

where df counts rows throughout, and df(c, t) those with t among the ``reach`` words next to c. PMI equals IC when t never comes without c. How sure
a corpus makes that is part of the measure: for the observed df(c, t) / df(t) its lower confidence bound (Wilson's, at ``z`` deviations) is
taken, so

    share(c; t) = log2(bound(df(c, t), df(t)) * D / df(c)) / IC(c)

A term seen once beside an entity seen once loses one bit by it, one seen ten times a seventh of a bit. A term whose share is ``remove`` or more is
removed, one at ``generalise`` or more is replaced by the most specific of its general forms - its first four characters, its first two,
its class (word or number) - whose own share, counted alike over all words of that form, is under ``generalise``; the class says nothing and always will do.
A term beside several entities takes the most general of their verdicts.

Counting: (1) entities and the words next to them are found map-side and only these small rows are shuffled. (2) df(t) is counted over
all rows, but only for the terms and forms of (1): a bitmap over their hashes, 16 bits for each up to ``MOST_BITS``
in all (4 MiB), is sent to the tasks, which drop others before any shuffle, and a join removes what the bitmap let through. Every group is
combined before its shuffle; joins on entity and term leave skew to the adaptive join.

Offsets are code points, ends exclusive. Base kinds: leftmost matches that don't overlap, one kind at a time; matches that
fail their test are dropped without another try.

Defined cases: a null text counts as empty; rows with null or repeated doc_ids stand for themselves (rows equal in id and text
give equal results); an empty table gives no rows; extra columns are carried by ``sanitise`` and ignored by ``find``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import flat_bytes, lean, slices
from auditloom.llm._store import drop, save

#: Kinds in order, and their patterns (fixed values).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM, REMOVED = "term", "removed"
REACH, Z, GENERALISE, REMOVE = 5, 1.0, 0.6, 0.9
#: Characters that the general forms of a term keep, the most specific form first.
PREFIXES = (4, 2)
LEAST_BITS, MOST_BITS = 16, 25
#: Bytes of text whose words are counted together, and what a task's tables hold before they are emptied.
SLICE, MOST_FORMS, MOST_WORDS = 1 << 20, 100_000, 250_000
# The same matches as the patterns' in linear time: a run of digits is tried once, from its start, and an address from its @.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_PHONE = re.compile(PATTERNS["phone"])
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_LONG_DIGITS = re.compile(r"(?:[0-9][\x20-]?){12}[0-9]")
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            free = host.end()
            out.append((begin, free))
        at = text.find("@", max(at + 1, free))
    return out


def _cards(text: str) -> list[tuple[int, int]]:
    if not _LONG_DIGITS.search(text):
        return []
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def find_base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", *span) for span in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split("."))]
    out += [("card", *span) for span in _cards(text)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _neighbours(text: str, spans: list[tuple[str, int, int]], reach: int) -> Iterator[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words next to each span: ``reach`` on each side, words that touch a span passed over."""
    taken = sorted((a, b) for _, a, b in spans)
    words, at, upto = [], 0, -1
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            upto = max(upto, taken[at][1])
            at += 1
        if upto <= m.start():
            words.append(m.span())
    starts = [s for s, _ in words]
    for kind, a, b in spans:
        value = text[a:b]
        entity = f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else ''.join(filter(str.isdigit, value))}"
        before, after = bisect_left(starts, a), bisect_left(starts, b)
        for s, e in (*words[max(0, before - reach) : before], *words[after : after + reach]):
            yield entity, text[s:e].lower(), s, e


def general_form(term: str, level: int) -> str:
    """What a term becomes: at levels 1 and 2 a general form, beyond them its class."""
    if level <= len(PREFIXES):
        return term[: PREFIXES[level - 1]] + "*"
    return "[NUMBER]" if term.isdigit() else "[WORD]"


def _forms(terms: pa.Array) -> list[pa.Array]:
    """Terms, then their general forms, the most specific first: null where a term is too short for one. A mark that no word holds ends a general form."""
    size = pc.utf8_length(terms)
    return [terms, *(pc.if_else(pc.greater(size, n), pc.binary_join_element_wise(pc.utf8_slice_codeunits(terms, 0, n), "*", ""), None) for n in PREFIXES)]


def _hash(terms: pa.Array, bits: int) -> np.ndarray:
    """A number below 2**bits for each string: its bytes as the coefficients of a polynomial modulo 2**64, mixed."""
    data, at = flat_bytes(terms)
    size = np.diff(at)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[place], dtype=np.uint64)])
    h = upto[at[1:]] - upto[at[:-1]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def with_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A key that rows share only if their id and text are equal."""
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


FOUND = "key string, n array<int>, base string, terms array<struct<entity:string,term:string,start:int,end:int>>"


def find_entities(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """A row a document that has base spans: its key, counts by kind, spans and the terms next to them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("entity", "term", "start", "end")
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
        for batch in batches:
            keys, ns, bases, terms = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = find_base(text) if text else []
                if spans:
                    count = Counter(k for k, _, _ in spans)
                    keys.append(key)
                    ns.append([count[k] for k in KINDS])
                    bases.append(spans_digest(spans))
                    terms.append([dict(zip(names, x, strict=True)) for x in _neighbours(text, spans, reach)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ns, pa.list_(pa.int32())), pa.array(bases, pa.string()), pa.array(terms, pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))], names=["key", "n", "base", "terms"])

    return docs.select(with_key(docs, id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, FOUND)


class FormCounter:
    """How many texts hold a word of each wanted form. Words become numbers, and pairs of text and form are made distinct, in numpy."""

    def __init__(self, bitmap: np.ndarray, bits: int):
        self.bitmap, self.bits = bitmap, bits
        self._clear()

    def _clear(self) -> None:
        #: Numbers and counts of wanted forms met.
        self.forms: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)
        self._forget()

    def _forget(self) -> None:
        #: Rows of ``of`` by word; a row has the numbers of a word's forms, -1 where one isn't wanted.
        self.known: dict[str, int] = {}
        self.of = np.zeros((0, 1 + len(PREFIXES)), np.int64)

    def _learn(self, words: list[str]) -> None:
        rows = np.full((len(words), self.of.shape[1]), -1, np.int64)
        for k, made in enumerate(_forms(pa.array([w.lower() for w in words], pa.string()))):
            at = _hash(made, self.bits)
            hit = ((self.bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool) & made.is_valid().to_numpy(zero_copy_only=False)
            rows[hit, k] = [self.forms.setdefault(f, len(self.forms)) for f in made.filter(pa.array(hit)).to_pylist()]
        self.known.update(zip(words, range(len(self.of), len(self.of) + len(words)), strict=True))
        self.of = np.concatenate([self.of, rows])
        self.counts = np.pad(self.counts, (0, len(self.forms) - len(self.counts)))

    def add(self, texts: list[list[str]]) -> None:
        if len(self.known) > MOST_WORDS:
            self._forget()
        words = pa.array(list(chain.from_iterable(texts)), pa.string()).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        row = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        form = self.of[row]
        pairs = (text[:, None] * len(self.forms) + form)[form >= 0]
        if len(pairs):
            self.counts += np.bincount(np.unique(pairs) % len(self.forms), minlength=len(self.counts))

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(self.forms), pa.string()), pa.array(self.counts)], names=["form", "n"])
        self._clear()
        return out


def term_counts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(form, df): rows that hold a word of the form, for the forms of ``wanted`` only."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * wanted.count()).bit_length()))

    @lean
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_hash(batch.column(0), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(1 << (at & 31))], names=["word", "bit"])

    words = wanted.select("form").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 5), np.uint32)  # as many rows at most, 2**20
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = FormCounter(sent.value, bits)
        for whole in batches:
            for batch in slices(whole, "t", SLICE):
                counter.add([_WORD.findall(t) if t else [] for t in batch.column(0).to_pylist()])
                if len(counter.forms) > MOST_FORMS:
                    yield counter.take()
        yield counter.take()

    all_ = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("df"))
    return all_.join(wanted, "form", "left_semi")


def _bound(k: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share of which k in n were seen."""
    return (k + z * z / 2 - z * F.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)


def disclosures(docs: DataFrame, found: DataFrame, text_col: str, z: float) -> DataFrame:
    """(entity, form, share) of all terms next to an entity and their general forms. found has one row a key, and ``rows`` it stands for."""
    rows = found.select("key", "rows", F.inline("terms"))
    general = [F.when(F.length("term") > n, F.concat(F.substring("term", 1, n), F.lit("*"))) for n in PREFIXES]
    formed = rows.select("entity", F.explode(F.array_compact(F.array("term", *general))).alias("form"), "key", "rows")
    together = save(formed.groupBy("entity", "form", "key").agg(F.max("rows").alias("rows")).groupBy("entity", "form").agg(F.sum("rows").alias("both")), "together")
    if together.isEmpty():
        return together.select("entity", "form", F.lit(0.0).alias("share"))
    entities = rows.groupBy("entity", "key").agg(F.max("rows").alias("rows")).groupBy("entity").agg(F.sum("rows").alias("df_entity"))
    total = docs.count()
    wanted = save(together.select("form").distinct(), "forms")
    df = term_counts(docs, text_col, wanted)
    scored = together.join(entities, "entity").join(df, "form")
    bits = F.log2(total / F.col("df_entity"))
    told = F.log2(_bound(F.col("both"), F.col("df"), z) * total / F.col("df_entity"))
    shares = save(scored.select("entity", "form", F.when(bits > 0, told / bits).otherwise(F.lit(0.0)).alias("share")), "shares")
    drop(together, wanted)
    return shares


def verdicts(shares: DataFrame, generalise: float, remove: float) -> DataFrame:
    """(entity, term, level) of terms that disclose too much: the general form to use, or one beyond the last level to remove."""
    terms = shares.filter((F.col("share") >= generalise) & ~F.col("form").endswith("*")).select("entity", F.col("form").alias("term"), F.col("share").alias("s0"))
    last = len(PREFIXES) + 1
    level = F.lit(last)
    for i, n in reversed(list(enumerate(PREFIXES, 1))):
        form = F.when(F.length("term") > n, F.concat(F.substring("term", 1, n), F.lit("*")))
        terms = terms.withColumn(f"f{i}", form)
        held = shares.select(F.col("entity").alias("e"), F.col("form").alias("f"), F.col("share").alias(f"s{i}"))
        terms = terms.join(held, (F.col("entity") == F.col("e")) & (F.col(f"f{i}") == F.col("f")), "left").drop("e", "f")
        level = F.when(F.col(f"s{i}") < generalise, i).otherwise(level)
    return terms.select("entity", "term", F.when(F.col("s0") >= remove, last + 1).otherwise(level).alias("level"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, z: float = Z, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(key, n, base, added) for rows that have findings; added: array<struct<removed, start, end, level>>, generalised terms first, each kind by start."""
    found = find_entities(docs, id_col, text_col, reach).groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "base", "terms")), F.count("*").alias("rows"))
    found = save(found, "entities")
    over = verdicts(disclosures(docs, found, text_col, z), generalise, remove)
    hits = found.select("key", F.inline("terms")).join(over, ["entity", "term"]).groupBy("key", "start", "end").agg(F.max("level").alias("level"))
    last = len(PREFIXES) + 1
    added = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((F.col("level") > last).alias("removed"), "start", "end", "level"))).alias("added"))
    return found.select("key", "n", "base").join(added, "key", "left")


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row a document: counts of the base kinds, digest of the base spans, all spans."""
    found = find(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), with_key(docs, id_col, text_col).alias("key")).join(found, "key", "left")
    base = F.coalesce("base", F.lit(""))
    added = F.array_join(F.transform("added", lambda s: F.concat_ws(":", F.when(s["removed"], REMOVED).otherwise(TERM), s["start"], s["end"])), ",")
    spans = F.concat_ws(",", "base", F.when(F.size("added") > 0, added))
    return rows.select("doc_id", *(F.coalesce(F.get("n", F.lit(i)), F.lit(0)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def mask(text: str, base: list[tuple[str, int, int]], added: list[tuple[int, int, int]]) -> str:
    """The text with base spans as [KIND], generalised terms in their general form and removed terms gone; added: (start, end, level).

    Base spans that touch one another merge; terms touch no base span.
    """
    out, at = [], 0
    spans = [(a, -b, f"[{kind.upper()}]") for kind, a, b in base]
    spans += [(a, -b, "" if level > len(PREFIXES) + 1 else general_form(text[a:b], level)) for a, b, level in added]
    for a, b, label in sorted(spans):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """``docs`` with all spans masked in the text; ``length_col``, if given, is set to the new length. All rows stay."""
    found = find(docs, id_col, text_col, **options)
    columns = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), with_key(docs, id_col, text_col).alias("key")).join(found.select("key", "added"), "key", "left").select("row", "added")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = row.field(columns.index(text_col)).to_pylist()
            masked = []
            for text, added in zip(texts, batch.column(1).to_pylist(), strict=True):
                base = find_base(text) if text else []
                masked.append(mask(text, base, [(s["start"], s["end"], s["level"]) for s in added or ()]) if base or added else text)
            arrays = [row.field(i) for i in range(len(columns))]
            arrays[columns.index(text_col)] = pa.array(masked, pa.string())
            if length_col:
                kind = arrays[columns.index(length_col)].type
                arrays[columns.index(length_col)] = pa.array([None if t is None else len(t) for t in masked], kind)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return held.mapInArrow(run, docs.schema)
