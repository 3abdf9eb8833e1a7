"""Commits: log lines, skip and exclude rules, message patterns, files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.ecmascript import java_pattern, trim
from auditloom.operators.classify import git_source

#: type, pattern, required or not.
CommitPattern = tuple[str, str, bool]


def parse_log(df: DataFrame, line: str = "line") -> DataFrame:
    """(hash, message, author, date) of lines ``hash|message|author|date``. A bar in a message shifts what follows, as in the log format itself."""
    parts = F.split(line, r"\|")
    fields = [F.coalesce(trim(F.get(parts, F.lit(i))), F.lit("")).alias(name) for i, name in enumerate(("hash", "message", "author", "date"))]
    return df.select(*fields).filter(F.col("hash") != "")


def valid(pattern: str) -> bool:
    """Whether the engine that will run a pattern takes it; without a session, whether Python does, for which named groups are rewritten.

    Python's own form of named groups is refused either way.
    """
    context = SparkContext._active_spark_context
    try:
        if context is None:
            if re.search(r"(?<!\\)(?:\\\\)*\(\?P", pattern):
                return False
            re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
        else:
            context._jvm.java.util.regex.Pattern.compile(java_pattern(pattern, True))
    except (re.error, Py4JJavaError, IllegalArgumentException):
        return False
    return True


def skipped(message: Column, skip: Sequence[str]) -> Column:
    """Whether a message holds one of the strings, whatever their case."""
    out = F.lit(False)
    for s in skip:
        out = out | F.contains(F.lower(message), F.lit(s.lower()))
    return out


def excluded(message: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns matches, whatever the case; invalid ones are passed over."""
    out = F.lit(False)
    for p in filter(valid, patterns):
        out = out | message.rlike(java_pattern(p, True))
    return out


def match_patterns(message: Column, patterns: Sequence[CommitPattern], mode: str = "any") -> Column:
    """struct<matched, type, matched_types, missing>: by any pattern, or by all required ones. Invalid patterns never match."""
    found = F.filter(F.array(*(F.when(message.rlike(java_pattern(p, True)) if valid(p) else F.lit(False), F.struct(F.lit(t).alias("type"), F.lit(p).alias("pattern"))) for t, p, _ in patterns)), lambda x: x.isNotNull())
    required = [(t, p) for t, p, r in patterns if r] if mode == "all" else []
    names = F.transform(found, lambda x: x["pattern"])
    missing = F.filter(F.array(*(F.when(~F.array_contains(names, p), F.lit(t)) for t, p in required)), lambda x: x.isNotNull()) if required else F.array().cast("array<string>")
    matched = F.size(missing) == 0 if required else F.size(found) > 0
    return F.struct(matched.alias("matched"), F.get(found, F.lit(0))["type"].alias("type"), F.transform(found, lambda x: x["type"]).alias("matched_types"), missing.alias("missing"))


def filter_commits(df: DataFrame, skip: Sequence[str] = (), exclude: Sequence[str] = (), patterns: Sequence[CommitPattern] = (), mode: str = "any", by_pattern: bool = True, message: str = "message") -> DataFrame:
    """Commits that are neither skipped nor excluded and, if asked, match the patterns."""
    out = df.filter(~skipped(F.col(message), skip)).filter(~excluded(F.col(message), exclude))
    return out.filter(match_patterns(F.col(message), patterns, mode)["matched"]) if by_pattern and patterns else out


def distinct_files(df: DataFrame, files: str = "files", order: str = "position") -> DataFrame:
    """(file, first): each file of any commit once, with where it was seen first."""
    rows = df.select(order, F.posexplode(files).alias("at", "file"))
    return rows.groupBy("file").agg(F.min(F.struct(order, "at")).alias("first"))


def recent(df: DataFrame, n: int = 1, date: str = "date", tie: str = "hash") -> DataFrame:
    return df.orderBy(F.desc(date), tie).limit(n)


def review_commits(log: DataFrame, n: int = 1, merges: bool = False, compare: str | None = None, head: str = "HEAD", date: str = "date", tie: str = "hash") -> DataFrame:
    """Commits to review, newest first: the last ``n``, or with ``compare`` those that ``head`` has and ``compare`` hasn't.

    ``log`` holds ``parents`` (array) and ``branches`` (array of the refs that reach a commit). A branch that no commit names falls
    back to the last ``n``, as does a log without one; commits of several parents go unless ``merges``. Null arrays count as empty.
    """
    holds = lambda ref: F.coalesce(F.array_contains("branches", ref), F.lit(False))
    rows = log if merges else log.filter(F.coalesce(F.size("parents"), F.lit(0)) < 2)
    rows = rows.filter(holds(head))
    if compare and not log.filter(holds(compare)).isEmpty():
        return rows.filter(~holds(compare)).orderBy(F.desc(date), tie)
    return recent(rows, n, date, tie)


def changed_paths(df: DataFrame, line: str = "line", only: str = "ACMR", sources: bool = False) -> DataFrame:
    """(status, path) of name-status lines: added, copied, modified and renamed paths, by their new names; with ``sources`` only source files."""
    parts = F.split(F.col(line), "\t")
    rows = df.select(F.substring(F.get(parts, F.lit(0)), 1, 1).alias("status"), trim(F.element_at(parts, -1)).alias("path"), F.size(parts).alias("n"))
    rows = rows.filter((F.col("n") > 1) & (F.col("path") != "") & F.col("status").isin(*only)).drop("n")
    return rows.filter(git_source(F.col("path"))) if sources else rows


def examples(messages: DataFrame, n: int = 3, width: int = 7, date: str = "date", tie: str = "hash") -> DataFrame:
    """(hash, message) of the newest ``n`` commits, hashes cut to ``width`` characters."""
    return recent(messages, n, date, tie).select(F.substring("hash", 1, width).alias("hash"), "message")
