r"""Repair of conversations at least cost, by a recursive DuckDB query inside hash-partitioned batches.

A repaired conversation's role initials read ``(s?(ua)+)?``. Each turn is kept (0), given the role user or assistant (2) or
deleted (3; a must for blank turns and for repetitions); empty user or assistant turns may be inserted anywhere (2); a
truncated turn that stays costs 1. The states of the grammar are: nothing yet, after s, after u, after a. Every recursion of the query advances one turn for all
conversations of a batch and keeps, for each conversation and state, the least cost and of those audits the least in ASCII
(``USING KEY``). Two audits of equal cost in one state never are prefixes of one another (what they differ by would
be insertions, which cost), so the least one stays the least whatever follows. More than two insertions in a row are never worth their cost.

Rows are dealt by conversation, sorted within partitions, and streamed in batches of whole conversations. A conversation of more than
``long_turns`` turns or ``long_bytes`` bytes isn't held by one task: equal rows of it are counted, its turns get global ranks and are dealt
in segments of ``long_turns``; the same query gives each segment's least costs from every state to every state, a stream of these
small rows joins them, and a last stream applies the edits to the turns. Only that stream, whose digest is one by definition, passes a
conversation through one task, a turn at a time.

Turns are ordered by turn (nulls first), then role, then text. Defined cases: null texts and roles count as one space, so such texts
are blank and such roles illegal, as is an empty role; rows without a conversation id are one conversation; repeated rows are turns of their own, of which
all but the first are duplicates; gaps ignore null turns; a conversation without rows (all of them not ``present``) gives zeros, an empty
audit and the digest of nothing; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._arrow import lean
from auditloom.llm._store import drop, save
from auditloom.operators.rank import ranked

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LONG_TURNS, LONG_BYTES = 1024, 32 << 20
#: Rows and bytes of text after which a batch of whole conversations is repaired.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST = 2, 3, 2
#: State by state, where a role's initial leads: 0 nothing yet, 1 after s, 2 after u, 3 after a. Texts may end in 0 and 3.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTED = (0, 3)


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after none to two insertions."""
    out = [(state, 0, "")]
    for _ in range(2):
        q, cost, audit = out[-1]
        out.append((next(to for x, to in GRAMMAR[q].items() if x in "ua"), cost + INSERT_COST, audit + INSERT))
    return out


def _moves() -> list[tuple]:
    """(state, initial or null, letter, cost, insertions, next state) of one turn and the insertions after it."""
    out = []
    for p, leads in GRAMMAR.items():
        steps = [(None, DELETE, DELETE_COST, p)]
        steps += [(x, KEEP, 0, q) for x, q in leads.items()]
        steps += [(None, REROLE, REROLE_COST, q) for x, q in leads.items() if x in "ua"]
        out += [(p, initial, letter, cost + more, tail, to) for initial, letter, cost, q in steps for to, more, tail in _inserted(q)]
    return out


def _values(rows: list[tuple]) -> str:
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)


#: ``turns``: c, i (from 1), turn, initial, copies, blank, truncated, code (equal for equal role and text) and seen (equal turns stand in an earlier segment).
FAULTS_SQL = """
CREATE OR REPLACE TEMP TABLE faults AS
SELECT c, i, turn, initial, copies, fault, fault IN ('blank', 'duplicate') AS gone, lag(initial) OVER (PARTITION BY c ORDER BY i) AS earlier
FROM (SELECT *, CASE WHEN blank THEN 'blank'
                     WHEN seen OR row_number() OVER (PARTITION BY c, code ORDER BY i) > 1 THEN 'duplicate'
                     WHEN truncated THEN 'truncated' ELSE 'none' END AS fault FROM turns)
"""
REPAIR_SQL = f"""
CREATE OR REPLACE TEMP TABLE paths AS
WITH RECURSIVE best(c, start, state, i, cost, audit) USING KEY (c, start, state) AS (
    SELECT c, start, state, 0::BIGINT, cost::BIGINT, audit FROM (SELECT DISTINCT c FROM faults), starts
    UNION
    SELECT c, start, q, i, least.cost, least.audit FROM (
        SELECT b.c, b.start, m.q, f.i,
               min({{'cost': b.cost + m.cost + (f.fault = 'truncated' AND m.letter <> '{DELETE}')::INT + {DELETE_COST} * (f.copies - 1),
                    'audit': b.audit || m.letter || repeat('{DELETE}', f.copies - 1) || m.tail}}) AS least
        FROM best b JOIN faults f ON f.c = b.c AND f.i = b.i + 1
        JOIN (VALUES {_values(_moves())}) m(p, initial, letter, cost, tail, q)
          ON m.p = b.state AND (m.letter = '{DELETE}' OR NOT f.gone AND (m.initial IS NULL OR m.initial = f.initial))
        GROUP BY b.c, b.start, m.q, f.i)
)
SELECT c, start, state, cost, audit FROM best
"""
STATS_SQL = """
SELECT c, coalesce(TRY_CAST(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn) AS BIGINT), 0) AS gaps, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS n_turns,
       sum(CASE WHEN fault = 'blank' THEN copies ELSE 0 END)::BIGINT AS blank,
       sum(CASE WHEN fault = 'duplicate' THEN copies WHEN fault <> 'blank' THEN copies - 1 ELSE 0 END)::BIGINT AS duplicate,
       sum((fault = 'truncated')::INT)::BIGINT AS truncated,
       sum(coalesce((earlier || initial NOT IN ('su', 'ua', 'au'))::INT, 0) + copies - 1)::BIGINT AS illegal,
       arg_min(initial, i) AS first, arg_max(initial, i) AS last
FROM faults GROUP BY c ORDER BY c
"""
CHOSEN_SQL = f"SELECT c, least.cost AS cost, least.audit AS audit FROM (SELECT c, min({{'cost': cost, 'audit': audit}}) AS least FROM paths WHERE state IN {ACCEPTED} GROUP BY c) ORDER BY c"


class Repairer:
    """One DuckDB connection; ``segments`` asks for the paths from every state instead of those from the start."""

    def __init__(self, segments: bool):
        import duckdb

        self.base = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        starts = [(q, q, 0, "") for q in GRAMMAR] if segments else [(0, q, cost, audit) for q, cost, audit in _inserted(0)]
        self.base.execute(f"CREATE TABLE starts AS SELECT * FROM (VALUES {_values(starts)}) s(start, state, cost, audit)")

    def load(self, turns: pa.Table) -> None:
        self.base.register("turns", turns)
        self.base.execute(FAULTS_SQL)
        self.base.execute(REPAIR_SQL)
        self.base.unregister("turns")

    def rows(self, sql: str) -> list[dict]:
        return self.base.sql(sql).to_arrow_table().to_pylist()


class Edits:
    """Applies an audit's letters, turn by turn; ``state`` is that before the first."""

    def __init__(self, audit: str, state: int):
        self.audit, self.at, self.state = audit, 0, state

    def _role(self, role: str | None) -> str:
        leads = GRAMMAR[self.state]
        if role is None:
            role = "user" if "u" in leads else "assistant"
        self.state = leads[role[:1]]
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield INSERT, self._role(None), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of what is inserted before a turn, and of the turn itself unless it is deleted."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != DELETE:
            yield letter, self._role(role if letter == KEEP else None), text


def _rows(conversations: DataFrame, present: str | None) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("n"), text("role").alias("r"), text("text").alias("t"), (F.coalesce(F.col(present), F.lit(True)) if present else F.lit(True)).alias("p"))
    blank = ~F.col("t").rlike(r"[^\x20\x09-\x0D]")
    return rows.select("*", F.substring("r", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~F.col("t").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole conversations of a sorted stream, in tables of about BATCH_ROWS rows or BATCH_BYTES bytes."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            table = pa.Table.from_batches(held)
            cut = int(_edges(table.column("c"))[-2])
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows, size = table.num_rows - cut, sum(b.nbytes for b in held)
    if rows:
        yield pa.Table.from_batches(held)


def _edges(key: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    codes = pc.fill_null(key.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])


def _codes(table: pa.Table) -> np.ndarray:
    """A number for each different pair of role and text."""
    role, text = (table.column(x).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in ("r", "t"))
    return role << 32 | text


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    schema = "conv_id long, n long, edit string, role string, text string" if turns else RESULT

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(False)
        for table in _conversations(batches):
            edges = _edges(table.column("c"))
            convs = table.column("c").take(pa.array(edges[:-1])).to_pylist()
            there = table.column("p").to_numpy(zero_copy_only=False)
            c = np.repeat(np.arange(len(convs)), np.diff(edges))[there]
            live = table.filter(table.column("p"))
            first = np.searchsorted(c, np.arange(len(convs) + 1))
            n = len(c)
            repairer.load(pa.table({"c": c, "i": np.arange(n) - first[c] + 1, "turn": live.column("n"), "initial": live.column("initial"), "copies": np.ones(n, np.int64), "blank": live.column("blank"), "truncated": live.column("truncated"), "code": _codes(live), "seen": np.zeros(n, bool)}))
            stats = {r["c"]: r for r in repairer.rows(STATS_SQL)}
            chosen = {r["c"]: r for r in repairer.rows(CHOSEN_SQL)}
            roles, texts, out = live.column("r"), live.column("t"), []
            for k, conv in enumerate(convs):
                digest, edits, m = hashlib.sha256(), Edits(chosen[k]["audit"] if k in chosen else "", 0), 0
                a, b = int(first[k]), int(first[k + 1])
                made = [x for role, text in zip(roles[a:b].to_pylist(), texts[a:b].to_pylist(), strict=True) for x in edits.turn(role, text)]
                for letter, role, text in [*made, *edits.inserted()]:
                    digest.update(f"{chr(10) if m else ''}{role}:{text}".encode())
                    m += 1
                    if turns:
                        out.append((conv, m, letter, role, text))
                if not turns:
                    s = stats.get(k, {})
                    out.append((conv, *(s.get(x, 0) for x in ("gaps", "blank", "duplicate", "truncated", "illegal")), chosen[k]["cost"] if k in chosen else 0, edits.audit, digest.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names, kinds = zip(*((x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")), strict=True)
    dealt = rows.select("c", "n", "r", "t", "p", "initial", "blank", "truncated").repartition("c")
    return dealt.sortWithinPartitions("c", F.col("n").asc_nulls_first(), "r", "t").mapInArrow(run, schema)


class Path:
    """A segment's edits after those of the segments before. Paths share their beginnings; what no state's best path holds is freed."""

    __slots__ = ("audit", "before", "cost", "seg", "start")

    def __init__(self, before: Path | None, seg: int, start: int, cost: int, audit: str):
        self.before, self.seg, self.start, self.cost, self.audit = before, seg, start, cost, audit

    def trace(self, upto: Path | None = None) -> list[Path]:
        out, at = [], self
        while at is not None and at is not upto:
            out.append(at)
            at = at.before
        return out[::-1]


def _less(a: Path, b: Path) -> bool:
    """Whether a is cheaper, or as cheap and its audit less. Only what differs of the audits is read: paths join again a few segments back."""
    if a.cost != b.cost:
        return a.cost < b.cost
    x, y = a, b
    while x is not y:
        if y is None or x is not None and x.seg >= y.seg:
            x = x.before
        else:
            y = y.before
    return "".join(p.audit for p in a.trace(x)) < "".join(p.audit for p in b.trace(x))


SEGMENT = "c long, seg long, paths array<struct<start:int,state:int,cost:long,audit:string>>, low long, high long, n_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
PLAN = "c long, seg long, start int, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _segment_paths(placed: DataFrame) -> DataFrame:
    """For each segment its least paths from state to state, and its counts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(True)
        for table in _conversations(batches):
            edges = _edges(table.column("c"))
            keys = table.select(["conv", "seg"]).take(pa.array(edges[:-1])).to_pylist()
            c, n = np.repeat(np.arange(len(keys)), np.diff(edges)), table.num_rows
            repairer.load(pa.table({"c": c, "i": np.arange(n) - edges[c] + 1, "turn": table.column("n"), "initial": table.column("initial"), "copies": table.column("copies"), "blank": table.column("blank"), "truncated": table.column("truncated"), "code": np.arange(n), "seen": table.column("seen")}))
            paths: dict = {}
            for p in repairer.rows("SELECT * FROM paths"):
                paths.setdefault(p.pop("c"), []).append(p)
            out = [{"c": keys[s["c"]]["conv"], "seg": keys[s["c"]]["seg"], "paths": paths[s["c"]], **{k: v for k, v in s.items() if k not in ("c", "gaps")}} for s in repairer.rows(STATS_SQL)]
            yield pa.RecordBatch.from_pylist(out, shape)

    step = pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    shape = pa.schema([("c", pa.int64()), ("seg", pa.int64()), ("paths", pa.list_(step)), *((x, pa.int64()) for x in ("low", "high", "n_turns", "blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string())])
    # A batch ends between segments, so the segment takes the place of the conversation there.
    key = F.concat_ws(":", F.coalesce(F.col("c").cast("string"), F.lit("")), "seg")
    rows = placed.select(key.alias("c"), F.col("c").alias("conv"), "seg", "position", "n", "initial", "copies", "blank", "truncated", "seen")
    return rows.repartition("c").sortWithinPartitions("c", "position").mapInArrow(run, SEGMENT)


def _joined(segments: DataFrame) -> DataFrame:
    """The edits chosen for each segment; a conversation's last row bears its counts, cost and audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, best, sums, last = None, {}, {}, None

        def done() -> pa.RecordBatch:
            final = None
            for q in ACCEPTED:
                if q in best and (final is None or _less(best[q], final)):
                    final = best[q]
            chosen = final.trace()
            rows = [{"c": conv, "seg": p.seg, "start": p.start, "edits": p.audit} for p in chosen]
            rows[-1] |= {k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"cost": final.cost, "audit": "".join(p.audit for p in chosen), "gaps": 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["n_turns"]}
            return pa.RecordBatch.from_pylist(rows, shape)

        for batch in batches:
            for s in batch.to_pylist():
                if last is None or s["c"] != conv:
                    if last is not None:
                        yield done()
                    conv, last = s["c"], None
                    # What is inserted before the first turn stands as a segment of its own, before all others.
                    best = {q: Path(None, -1, 0, cost, audit) for q, cost, audit in _inserted(0)}
                    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0) | {"low": None, "high": None}
                fresh: dict = {}
                for p in s["paths"]:
                    if p["start"] in best:
                        path = Path(best[p["start"]], s["seg"], p["start"], best[p["start"]].cost + p["cost"], p["audit"])
                        if p["state"] not in fresh or _less(path, fresh[p["state"]]):
                            fresh[p["state"]] = path
                best = fresh
                for k in ("blank", "duplicate", "truncated", "illegal", "n_turns"):
                    sums[k] += s[k]
                if last is not None:
                    sums["illegal"] += last + s["first"] not in ("su", "ua", "au")
                    sums["n_turns"] -= s["low"] is not None and s["low"] == sums["high"]
                sums["low"] = s["low"] if sums["low"] is None else sums["low"]
                sums["high"] = sums["high"] if s["high"] is None else s["high"]
                last = s["last"]
        if last is not None:
            yield done()

    shape = pa.schema([("c", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("edits", pa.string()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    return segments.repartition("c").sortWithinPartitions("c", "seg").mapInArrow(run, PLAN)


def _long(rows: DataFrame, long: DataFrame, long_turns: int, turns: bool) -> DataFrame:
    """Conversations that no task should hold, in segments."""
    key = F.col("c").eqNullSafe(F.col("lc"))
    mine = rows.filter("p").join(long.select(F.col("c").alias("lc")), key, "left_semi")
    equal = mine.groupBy("c", "n", "r", "t", "initial", "blank", "truncated").agg(F.count(F.lit(1)).alias("copies"))
    first = equal.groupBy(F.col("c").alias("fc"), F.col("r").alias("fr"), F.col("t").alias("ft")).agg(F.min(F.struct("n")).alias("f"))
    seen = equal.join(first, F.col("c").eqNullSafe(F.col("fc")) & (F.col("r") == F.col("fr")) & (F.col("t") == F.col("ft"))).select(*equal.columns, (~F.col("n").eqNullSafe(F.col("f.n"))).alias("seen"))
    written = save(seen, "turns")
    placed = ranked(written, F.col("c").asc_nulls_first(), F.col("n").asc_nulls_first(), "r", "t").withColumn("seg", F.floor(F.col("position") / long_turns))
    drop(written)
    plan = save(_joined(_segment_paths(placed)), "plan")
    names = [x.split()[0] for x in PLAN.split(", ")]
    nothing = lambda kept: [F.lit(None).cast(dict(x.split() for x in PLAN.split(", "))[n]).alias(n) for n in names if n not in kept]
    body = [F.lit(None).cast(k).alias(n) for n, k in (("r", "string"), ("t", "string"), ("copies", "long"))]
    # In order: a conversation's name, then each segment's edits and its turns.
    heads = long.select("c", F.lit(-2).cast("long").alias("seg"), F.lit(-1).cast("long").alias("position"), *nothing(("c", "seg")), *body)
    heads = heads.unionByName(plan.select("*", F.lit(-1).cast("long").alias("position"), *body))
    stream = heads.unionByName(placed.select("c", "seg", "position", *nothing(("c", "seg")), "r", "t", "copies"))
    schema = "conv_id long, n long, edit string, role string, text string" if turns else RESULT

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = edits = digest = stats = None
        m, some = 0, False

        def done() -> pa.RecordBatch:
            values = stats or dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": ""}
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()} | {k: values[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}], shape)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                made: list = []
                if row["seg"] == -2:
                    if some and not turns:
                        yield done()
                    conv, some, digest, stats, edits, m = row["c"], True, hashlib.sha256(), None, None, 0
                elif row["position"] == -1:
                    edits = Edits(row["edits"], row["start"])
                    stats = row if row["audit"] is not None else stats
                    made = list(edits.inserted())
                else:
                    made = list(edits.turn(row["r"], row["t"]))
                    edits.at += row["copies"] - 1
                    made += edits.inserted()
                for letter, role, text in made:
                    digest.update(f"{chr(10) if m else ''}{role}:{text}".encode())
                    m += 1
                    out.append({"conv_id": conv, "n": m, "edit": letter, "role": role, "text": text})
            if turns and out:
                yield pa.RecordBatch.from_pylist(out, shape)
        if some and not turns:
            yield done()

    shape = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")])
    return stream.repartition("c").sortWithinPartitions("c", "seg", "position").mapInArrow(run, schema)


def repair(conversations: DataFrame, present: str | None = None, turns: bool = False, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """A row a conversation (RESULT); with ``turns`` the repaired turns instead, each with the edit that made it.

    ``present``: a boolean column; rows where it is false only name their conversation.
    """
    rows = _rows(conversations, present)
    size = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("bytes"))
    long = save(size.filter((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)).select("c"), "long")
    if long.isEmpty():
        drop(long)
        return _short(rows, turns)
    short = rows.join(long.select(F.col("c").alias("lc")), F.col("c").eqNullSafe(F.col("lc")), "left_anti")
    return _short(short, turns).unionByName(_long(rows, long, long_turns, turns))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations as the query damages them: one in twenty rows each dropped (not ``present``), emptied, robbed of its sentence ends, repeated, given the role user."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), (F.col("kind") != 0).alias("present"), times).drop("copy")
