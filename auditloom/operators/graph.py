"""The commit graph: ancestors, merge bases and the commits of a branch, from hashes and parents alone.

A log may hold the commits of any number of repositories; hashes tell them apart. Unbranched chains (a commit of one
parent that has one child) are contracted first by pointer doubling, which takes as many rounds as the longest chain has binary
digits. Reachability then spreads over whole chains, semi-naively: each round joins only the chains found in the last one and drops those
seen before, so there are as many rounds as branchings and merges lie on the longest way down, not commits. Every round is a job over
distributed tables that are written to the shared folder; the driver only asks whether a round found anything. Tables that grow with the log are
joined by merging, never broadcast: a broadcast goes through the driver, and one a round adds up. Only a closure's chains may be at its end, once, and the best bases.

Rows without a hash are left out, rows of one hash count as one commit with all their parents, and parents that the log lacks (a
shallow clone) are left out. Null parents are none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.sources.store import drop, save

#: Rounds of spreading after which what was seen is written as one table.
COMPACT = 8


@dataclass(frozen=True)
class CommitGraph:
    """Saved tables: edges (child, parent), placed (hash, chain, depth) and steps from chain to chain (chain, below)."""

    edges: DataFrame
    placed: DataFrame
    steps: DataFrame


def graph_edges(log: DataFrame) -> DataFrame:
    """(child, parent), each once; both stand in the log."""
    known = log.select(F.col("hash").alias("parent")).filter("parent IS NOT NULL").distinct()
    pairs = log.filter("hash IS NOT NULL").select(F.col("hash").alias("child"), F.explode("parents").alias("parent"))
    return pairs.filter("child <> parent").distinct().join(known.hint("merge"), "parent", "left_semi").select("child", "parent")


def chains(log: DataFrame, edges: DataFrame) -> DataFrame:
    """(hash, chain, depth): the chain's lowest commit, and how many links above it a commit stands.

    Only commits that aren't known to have arrived are joined on. Their next commits differ, but for one a chain, so no task gets a whole chain.
    """
    one_parent = edges.groupBy("child").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    one_child = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("parent")
    links = one_parent.join(one_child.hint("merge"), "parent", "left_semi").withColumnRenamed("child", "hash")
    commits = log.select("hash").filter("hash IS NOT NULL").distinct()
    jumps = save(commits.join(links.hint("merge"), "hash", "left").select("hash", F.coalesce("parent", "hash").alias("chain"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNotNull().alias("open")), "chains")
    while not jumps.filter("open").isEmpty():
        onward = jumps.select(F.col("hash").alias("chain"), F.col("chain").alias("to"), F.col("depth").alias("more"), F.col("open").alias("still"))
        longer = jumps.filter("open").join(onward.hint("merge"), "chain").select("hash", F.col("to").alias("chain"), (F.col("depth") + F.col("more")).alias("depth"), F.col("still").alias("open"))
        last, jumps = jumps, save(jumps.filter("NOT open").unionByName(longer), "chains")
        drop(last)
    return jumps.drop("open")


def commit_graph(log: DataFrame) -> CommitGraph:
    """The graph of a log (hash, parents), for any number of closures."""
    edges = save(graph_edges(log), "edges")
    placed = chains(log, edges)
    lower = placed.filter("depth = 0").select(F.col("hash").alias("child"), "chain")
    tops = placed.select(F.col("hash").alias("parent"), F.col("chain").alias("below"))
    return CommitGraph(edges, placed, save(edges.join(lower.hint("merge"), "child").join(tops.hint("merge"), "parent").select("chain", "below").distinct(), "steps"))


def ancestors(graph: CommitGraph, starts: DataFrame) -> DataFrame:
    """(name, hash): every commit that each start (name, hash) reaches, itself included. Starts that the log lacks reach nothing."""
    placed, steps = graph.placed, graph.steps
    first = save(starts.select("name", "hash").distinct().join(placed.hint("merge"), "hash").select("name", "chain", "depth"), "starts")
    found, new = [], save(first.join(steps.hint("merge"), "chain").select("name", F.col("below").alias("chain")).distinct(), "reached")
    while not new.isEmpty():
        found.append(new)
        if len(found) > COMPACT:
            one = save(reduce(DataFrame.unionByName, found), "reached")
            drop(*found[:-1])
            found = [one]
        seen = reduce(DataFrame.unionByName, found)
        new = save(new.join(steps.hint("merge"), "chain").select("name", F.col("below").alias("chain")).distinct().join(seen.hint("merge"), ["name", "chain"], "left_anti"), "reached")
    whole = reduce(DataFrame.unionByName, [*found, new]).withColumn("most", F.lit(None).cast("long"))
    reached = whole.unionByName(first.withColumnRenamed("depth", "most"))
    return reached.join(placed, "chain").filter("most IS NULL OR depth <= most").select("name", "hash").distinct()


def merge_bases(graph: CommitGraph, reached: DataFrame, one: str, other: str) -> DataFrame:
    """(hash): best common ancestors of the starts ``one`` and ``other`` in ``reached``: those that no other common ancestor has as a parent.

    The common ancestors hold all ancestors of their own, so one look at the parents is enough.
    """
    both = reached.filter(F.col("name").isin(one, other)).groupBy("hash").agg(F.countDistinct("name").alias("n")).filter("n = 2").select("hash")
    below = graph.edges.join(both.withColumnRenamed("hash", "child").hint("merge"), "child", "left_semi").select(F.col("parent").alias("hash"))
    return both.join(below.hint("merge"), "hash", "left_anti")


def branch_commits(log: DataFrame, refs: DataFrame, n: int = 1, merges: bool = False, compare: str | None = None, head: str = "HEAD", date: str = "date") -> DataFrame:
    """Commits to review, newest first, from ``log`` (hash, parents, ...) and ``refs`` (ref, hash).

    Without ``compare``, or where no such ref points into the log, the last ``n`` commits that ``head`` reaches. Else those that ``head``
    reaches and their merge base doesn't; of several bases the newest (then the least hash) counts, as a single one is asked for. Where the
    histories have none in common, those that ``compare`` doesn't reach. Commits of several parents go unless ``merges``.
    """
    starts = refs.filter(F.col("ref").isin(*filter(None, (head, compare)))).select(F.col("ref").alias("name"), "hash")
    graph = commit_graph(log)
    reached = save(ancestors(graph, starts), "ancestors")
    mine, order = reached.filter(F.col("name") == head).select("hash"), (F.desc(date), F.col("hash"))
    rows = log.dropDuplicates(["hash"]) if merges else log.dropDuplicates(["hash"]).filter(F.coalesce(F.size("parents"), F.lit(0)) < 2)
    if not compare or reached.filter(F.col("name") == compare).isEmpty():
        return rows.join(mine.hint("merge"), "hash", "left_semi").orderBy(*order).limit(n)
    bases = save(merge_bases(graph, reached, head, compare), "bases")
    best = log.join(bases, "hash", "left_semi").select("hash", date).distinct().orderBy(*order).limit(2).collect()
    if len({r["hash"] for r in best}) < 2:
        hidden = reached.filter(F.col("name") == compare).select("hash")
    else:
        start = log.sparkSession.createDataFrame([("base", best[0]["hash"])], "name string, hash string")
        hidden = ancestors(graph, start).select("hash")
    return rows.join(mine.hint("merge"), "hash", "left_semi").join(hidden.hint("merge"), "hash", "left_anti").orderBy(*order)


def reaches(log: DataFrame, refs: DataFrame) -> DataFrame:
    """The log with ``branches``: the refs (ref, hash) that reach each commit, in order."""
    found = ancestors(commit_graph(log), refs.select(F.col("ref").alias("name"), "hash")).groupBy("hash").agg(F.array_sort(F.collect_set("name")).alias("branches"))
    none: Column = F.array().cast("array<string>")
    return log.join(found.hint("merge"), "hash", "left").withColumn("branches", F.coalesce("branches", none))
