r"""Secret scan by sliding-window Shannon entropy, in DataFrame functions only.

Base findings are the matches of three fixed patterns. The scan adds ``entropy`` findings: candidate strings (runs of one
character class) over which a window slides; the window's entropy follows from counts that change by one character in and
one out a step,

    H = log2(W) - (sum of c * log2(c) over the counts) / W

and a candidate is reported if some window exceeds its class's threshold, unless an allow-list pattern covers the candidate; windows that
overlap a dummy word don't count. A step replaces two bytes of a string of counts, so its cost depends on neither the
window nor the candidate. No pattern repeats a group: a text of any length and kind takes bounded stack.

Positions come from splitting a text by the same pattern that extracts the matches: a match ends where the lengths of all
pieces and matches up to it add up to. The running sum is taken in blocks, so its cost stays close to linear in
the number of matches. Offsets are code points, ends exclusive. There is no shuffle and no Python in the plan.

Defined cases: a null text counts as empty and has no findings; doc_id may be null or repeated, each row stands for itself; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length. Fixed values; runs shorter than the least are matches too and dropped.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, 2, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),  # as AKIA[A-Z0-9]+ of 18 or more: the run is the longest either way
    ("hex", "[0-9a-f]{16,}", 0, 16),  # as [0-9a-f]+ of 16 or more
)
#: Class, candidate pattern, window, bits of entropy that a window must exceed. No window of these lengths has exactly these values.
CLASSES = (
    ("hex", "[0-9A-Fa-f]{24,}", 24, 2.9501),
    ("alnum", "[A-Za-z0-9+/_-]{24,}", 24, 3.8501),
)
#: Candidates that are no secrets however varied their characters: one word, digits, UUIDs. No pattern repeats a group, as Java's
#: engine takes a stack frame for each repeat; words joined by marks are told by what they lack (``allowed``).
ALLOW = (
    r"[A-Za-z]?[a-z]+|[A-Z]+",
    r"[0-9+/_-]+",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
)
#: Dummies: no window may overlap one, but what stands beside it in the same candidate is judged on its own.
DUMMY = "(?i:example|placeholder|dummy|xxxx|0123456789|abcdefgh)"
#: Least code of a candidate's characters, and how many codes there are from it on.
FIRST, CODES = 43, 80
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def running_sum(numbers: Column) -> Column:
    """Sums up to each place of an array. Arrays grow within blocks of BLOCK only, and by one entry a block."""

    def sums(part: Column, base: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("all"), base.alias("sum"))
        return F.aggregate(part, start, lambda s, x: F.struct(F.concat(s["all"], F.array(s["sum"] + x)).alias("all"), (s["sum"] + x).alias("sum")))["all"]

    def whole(numbers: Column) -> Column:
        n = F.ceil(F.size(numbers) / BLOCK).cast("int")
        blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))
        return let(
            blocks,
            lambda parts: let(
                sums(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x)), F.lit(0)),
                lambda ends: F.flatten(F.transform(parts, lambda p, b: sums(p, F.when(b > 0, F.get(ends, b - 1)).otherwise(F.lit(0))))),
            ),
        )

    return let(numbers, whole)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; value is the given group."""

    def located(parts: Column) -> Column:
        return let(
            running_sum(F.zip_with(parts["piece"], parts["match"], lambda p, m: F.coalesce(F.length(p), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))),
            lambda ends: F.transform(parts["match"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.get(parts["value"], i).alias("value"))),
        )

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.struct(F.split(text, pattern, -1).alias("piece"), whole.alias("match"), value.alias("value"))
    return F.when(text.rlike(pattern), let(parts, located)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def peak_entropy(candidate: Column, window: int) -> Column:
    """Greatest entropy, in bits, of a window of ``window`` characters; 0 for shorter strings.

    The counts of a window are the bytes of a string with a place for each code, so that a step replaces two of them.
    """
    part = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))

    def slid(chars: Column) -> Column:
        def place(i: Column) -> Column:
            return F.ascii(F.element_at(chars, i)) - (FIRST - 1)

        def count(counts: Column, at: Column) -> Column:
            return F.ascii(F.substring(counts, at, F.lit(1))) - FIRST

        def put(counts: Column, at: Column, n: Column) -> Column:
            return F.overlay(counts, F.char(n + FIRST), at, F.lit(1))

        def gone(s: Column, i: Column) -> Column:
            """Counts and total without the character that leaves."""

            def less(at: Column) -> Column:
                return let(count(s["counts"], at), lambda n: F.struct(put(s["counts"], at, n - 1).alias("counts"), (s["total"] - F.get(part, n) + F.get(part, n - 1)).alias("total"), s["peak"].alias("peak")))

            return F.when(i > window, let(place(i - window), less)).otherwise(s)

        def come(s: Column, i: Column) -> Column:
            def more(at: Column) -> Column:
                return let(count(s["counts"], at), lambda n: let(s["total"] - F.get(part, n) + F.get(part, n + 1), lambda total: F.struct(put(s["counts"], at, n + 1).alias("counts"), total.alias("total"), F.greatest(s["peak"], F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))).alias("peak"))))

            return let(place(i), more)

        start = F.struct(F.lit(chr(FIRST) * CODES).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("peak"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, lambda s, i: let(gone(s, i), lambda t: come(t, i)), lambda s: s["peak"])

    return F.when(F.length(candidate) >= window, let(F.split(candidate, ""), slid)).otherwise(F.lit(0.0))


def varied(candidate: Column, window: int, bits: float) -> Column:
    """Whether a window that overlaps no dummy has more than ``bits`` bits."""
    return F.exists(F.split(candidate, DUMMY, -1), lambda piece: peak_entropy(piece, window) > bits)


def allowed(candidate: Column) -> Column:
    """Whether the allow-list covers a candidate. Words joined by marks: letters at both ends, no digit, no two marks in a row."""
    out = candidate.rlike(r"^[A-Za-z]") & candidate.rlike(r"[A-Za-z]\z") & ~candidate.rlike(r"[0-9]|[-_/+][-_/+]")
    for pattern in ALLOW:
        out = out | candidate.rlike(rf"^(?:{pattern})\z")
    return out


def _ranked(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of struct<start, rank, end, kind>, sorted by start, then kind as listed."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def long_enough(pattern: str, group: int, least: int) -> Column:
        return F.filter(matches(F.col("text"), pattern, group), lambda m: F.length(m["value"]) >= least)

    def suspects(pattern: str, window: int, bits: float) -> Column:
        candidates = F.filter(matches(F.col("text"), pattern), lambda m: ~allowed(m["value"]))
        return F.filter(candidates, lambda m: varied(m["value"], window, bits))

    base = [long_enough(pattern, group, least) for _, pattern, group, least in BASE]
    added = [suspects(pattern, window, bits) for _, pattern, window, bits in CLASSES]
    df = df.select("doc_id", *(_ranked(x, kind, i).alias(f"b{i}") for i, (x, (kind, *_)) in enumerate(zip(base, BASE, strict=True))), _ranked(F.array_distinct(F.concat(*added)), "entropy", len(BASE)).alias("added"))
    return df.select("doc_id", *(F.size(f"b{i}").cast("long").alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)), F.sort_array(F.concat(*(F.col(f"b{i}") for i in range(len(BASE))))).alias("base"), F.sort_array("added").alias("added"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: counts of the base kinds, the digest of base spans, and all spans."""
    found = scan(docs, id_col, text_col)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.sort_array(F.concat("base", "added"))).alias("spans"))


def _sql_matches(pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""(WITH m AS (SELECT string_split_regex(txt, '{p}') AS pieces, regexp_extract_all(txt, '{p}', 0) AS whole, regexp_extract_all(txt, '{p}', {group}) AS part)
      SELECT list_transform(range(1, len(whole) + 1), lambda i: {{'start': CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS INTEGER),
        'len': length(whole[i]), 'value': part[i]}}) FROM m)"""


def _sql() -> str:
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found = f"list_filter({_sql_matches(pattern, group)}, lambda m: length(m.value) >= {least})"
        spans.append((kind, rank, found))
    allow = " OR ".join("regexp_full_match(m.value, '{}')".format(p.replace("'", "''")) for p in (*ALLOW, "[A-Za-z]+([-_/+][A-Za-z]+)+"))
    added = []
    for _, pattern, window, bits in CLASSES:
        windows = f"list_transform(range(1, length(p) - {window} + 2), lambda i: list_entropy(string_split(p[i:i + {window} - 1], '')))"
        peak = f"list_max(flatten(list_transform(string_split_regex(m.value, '{DUMMY}'), lambda p: {windows})))"
        added.append(f"list_filter({_sql_matches(pattern)}, lambda m: NOT ({allow}) AND {peak} > {bits})")
    text = "(SELECT doc_id, coalesce(text, '') AS txt FROM documents)"
    struct = lambda kind, rank, x: f"list_transform({x}, lambda m: {{'start': m.start, 'rank': {rank}, 'end': m.start + m.len, 'kind': '{kind}'}})"
    join = lambda x: f"array_to_string(list_transform({x}, lambda s: s.kind || ':' || s.start || ':' || s.\"end\"), ',')"
    columns = ", ".join(f"{struct(kind, rank, x)} AS b{rank}" for kind, rank, x in spans)
    extra = struct("entropy", len(BASE), f"list_distinct(list_concat({', '.join(added)}))")
    return f"""SELECT doc_id, CAST(len(b0) AS BIGINT) AS n_assign, CAST(len(b1) AS BIGINT) AS n_access, CAST(len(b2) AS BIGINT) AS n_hex,
      sha256({join('list_sort(list_concat(b0, b1, b2))')}) AS base_sha256, {join('list_sort(list_concat(b0, b1, b2, added))')} AS spans
      FROM (SELECT doc_id, {columns}, {extra} AS added FROM {text})"""


ORACLE_SQL = _sql()
