"""The commit graph against a walk in memory, ranks and caps against sorting."""

from __future__ import annotations

import random

import pytest

from auditloom.operators import diff, graph
from auditloom.operators.rank import ranked

SCHEMA = "hash string, parents array<string>, date string"


def walk(parents, start):
    seen, todo = set(), [start] if start in parents else []
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += [p for p in parents[c] if p in parents]
    return seen


def expected(parents, dates, head, compare):
    mine, theirs = walk(parents, head), walk(parents, compare)
    both = mine & theirs
    best = [c for c in both if not any(c in walk(parents, d) for d in both if d != c)]
    hidden = walk(parents, max(sorted(best), key=lambda c: dates[c])) if best else theirs
    order = sorted((c for c in mine - hidden if len(parents[c]) < 2), key=lambda c: c)
    return sorted(order, key=lambda c: dates[c], reverse=True)


def random_graph(seed, n=36):
    rng = random.Random(seed)
    parents = {f"c{i:03}": [f"c{p:03}" for p in sorted(set(rng.choices(range(max(0, i - 6), i), k=rng.choice([1, 1, 1, 1, 2, 3]))))] if i and rng.random() > 0.03 else [] for i in range(n)}
    parents["c005"] = [*parents["c005"], "gone"]
    return parents, {c: f"2024-01-{rng.randint(10, 28)}" for c in parents}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    parents, dates = random_graph(seed)
    log = spark.createDataFrame([(c, p or None, dates[c]) for c, p in parents.items()] + [("c010", parents["c010"], dates["c010"]), (None, ["c001"], None)], SCHEMA).repartition(3)
    refs = spark.createDataFrame([("HEAD", "c035"), ("main", "c032"), ("lost", "nowhere")], "ref string, hash string")
    found = graph.reaches(log.filter("hash is not null").dropDuplicates(["hash"]), refs).collect()
    assert {r.hash: r.branches for r in found} == {c: [n for n, s in (("HEAD", "c035"), ("main", "c032")) if c in walk(parents, s)] for c in parents}
    got = [r.hash for r in graph.branch_commits(log, refs, compare="main").collect()]
    assert got == expected(parents, dates, "c035", "c032")
    last = [r.hash for r in graph.branch_commits(log, refs, 3, merges=True, compare="lost").collect()]
    assert last == sorted(sorted(walk(parents, "c035")), key=lambda c: dates[c], reverse=True)[:3]


def test_two_merge_bases_and_long_chains(spark):
    parents = {"r0": []} | {f"r{i}": [f"r{i - 1}"] for i in range(1, 1000)}
    for side in "ab":
        parents |= {f"{side}0": ["r999"]} | {f"{side}{i}": [f"{side}{i - 1}"] for i in range(1, 1000)}
    parents |= {"m1": ["a999", "b999"], "m2": ["b999", "a999"], "x": ["m1"], "y": ["m2"]}
    dates = dict.fromkeys(parents, "1") | {"a999": "2"}
    log = spark.createDataFrame([(c, p, dates[c]) for c, p in parents.items()], SCHEMA)
    refs = spark.createDataFrame([("HEAD", "x"), ("main", "y")], "ref string, hash string")
    made = graph.commit_graph(log)
    reached = graph.ancestors(made, refs.selectExpr("ref AS name", "hash"))
    assert {r.hash for r in graph.merge_bases(made, reached, "HEAD", "main").collect()} == {"a999", "b999"}
    assert {r.hash for r in graph.branch_commits(log, refs, compare="main").collect()} == {"x"} | {f"b{i}" for i in range(1000)}
    unrelated = spark.createDataFrame([("p", ["q"], "1"), ("q", None, "1"), ("s", [], "1")], SCHEMA)
    refs = spark.createDataFrame([("HEAD", "p"), ("main", "s")], "ref string, hash string")
    assert [r.hash for r in graph.branch_commits(unrelated, refs, compare="main").collect()] == ["p", "q"]


def test_no_round_sends_a_table_through_the_driver(spark, monkeypatch):
    parents = {"r0": []} | {f"r{i}": [f"r{i - 1}"] for i in range(1, 40)} | {"a": ["r39"], "b": ["r39"], "m": ["a", "b"]}
    log = spark.createDataFrame([(c, p, "1") for c, p in parents.items()], SCHEMA)
    plans, real = [], graph.save
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "save", lambda df, name: plans.append((name, plan(df))) or real(df, name))
    refs = spark.createDataFrame([("HEAD", "m"), ("main", "r5")], "ref string, hash string")
    found = graph.reaches(log, refs)
    plans.append(("ancestors", plan(found)))
    assert {r.hash: r.branches for r in found.collect()} == {c: [n for n, s in (("HEAD", "m"), ("main", "r5")) if c in walk(parents, s)] for c in parents}
    got = graph.branch_commits(log, refs, compare="main")
    plans.append(("ancestors", plan(got)))
    assert {r.hash for r in got.collect()} == walk(parents, "m") - walk(parents, "r5") - {"m"}
    assert {name for name, _ in plans} >= {"edges", "chains", "steps", "starts", "reached", "ancestors", "bases"}
    assert [name for name, p in plans if "Broadcast" in p and name != "ancestors"] == []
    # Only the few chains that a closure reached, at its end.
    assert all(p.count("BroadcastExchange") <= 1 for _, p in plans)


def test_no_commits(spark):
    log, refs = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("HEAD", "x")], "ref string, hash string")
    assert graph.branch_commits(log, refs, compare="main").collect() == [] and graph.branch_commits(log, refs).collect() == []


def test_ranks(spark):
    rng = random.Random(1)
    values = [(rng.choice([None, *range(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(values, "v int, i int").repartition(7)
    got = ranked(df, "v", "i").collect()
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.position)] == sorted(values, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(r.position for r in ranked(df.select("v"), "v").collect()) == list(range(1, 3001))
    assert ranked(df.limit(0), "v").collect() == []


def test_a_cap_over_all_paths_has_no_window_of_one_partition(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("aAbB_-./éz9") for _ in range(rng.randint(1, 6))) for _ in range(800)]
    df = spark.createDataFrame([(n, "all") for n in [*names, None]], "path string, one string").repartition(5)
    wanted = {r.path: (r.position, r.reason) for r in diff.cap_files(df, 20, by="one").collect()}
    every = diff.cap_files(df, 20)
    first = diff.cap_files(df, 20, positions=False)
    assert {r.path: (r.position, r.reason) for r in every.collect()} == wanted
    assert {r.path: (r.position, r.reason) for r in first.collect()} == {p: (n if n <= 20 else None, why) for p, (n, why) in wanted.items()}
    for df in (every, first):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
