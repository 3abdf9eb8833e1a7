"""Path classification: ignore rules, extension allow-list, sensitive names, blocked directories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions.ecmascript import basename, extension, trim


def glob_pattern(globs: Sequence[str]) -> str:
    """One anchored pattern, without case, for file name globs: ``*`` is any run, ``?`` makes what is before it optional."""
    parts = (re.sub(r"[.+^${}()|\[\]\\]", r"\\\g<0>", g).replace("*", ".*") for g in globs)
    return rf"(?i)^(?:{'|'.join(parts)})\z"


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(Java pattern over whole relative paths, negated) of each rule of an ignore file, in order."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[negated:].removeprefix("\\")
        only_dir, body = body.endswith("/"), body.rstrip("/")
        anchored = "/" in body
        out, i = [], 0
        body = body.removeprefix("/")
        while i < len(body):
            if body.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
            elif body.startswith("/**", i) and i + 3 == len(body):
                out.append("/.*")
                i += 3
            elif body[i] == "*":
                out.append("[^/]*")
                i += 1
            elif body[i] == "?":
                out.append("[^/]")
                i += 1
            elif body[i] == "[" and (end := body.find("]", i + 1)) > 0:
                out.append(body[i : end + 1].replace("[!", "[^", 1))
                i = end + 1
            else:
                out.append(re.escape(body[i]))
                i += 1
        rules.append((("^" if anchored else "^(?:.*/)?") + "".join(out) + (r"/.*\z" if only_dir else r"(?:/.*)?\z"), negated))
    return rules


def ignored(path: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """Whether the last matching rule ignores a path. A file below an ignored directory can't be taken back by a later rule for the file alone."""
    if not rules:
        return F.lit(False)
    own = F.lit(False)
    held = F.lit(False)
    for pattern, negated in rules:
        own = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(own)
    parents = F.transform(F.split(path, "/"), lambda x, i: F.array_join(F.slice(F.split(path, "/"), F.lit(1), i + 1), "/"))
    above = F.slice(parents, F.lit(1), F.size(parents) - 1)

    def of(p: Column) -> Column:
        out = F.lit(False)
        for pattern, negated in rules:
            out = F.when(F.concat(p, F.lit("/")).rlike(pattern.replace(r"(?:/.*)?\z", r"/?\z").replace(r"/.*\z", r"/\z")), F.lit(not negated)).otherwise(out)
        return out

    held = F.exists(above, of)
    return held | own


def path_reason(path: Column, rules: Sequence[tuple[str, bool]] = (), extensions: Sequence[str] = K.ALLOWED_EXTENSIONS, blocked: Sequence[str] = K.BLOCKED_PATTERNS) -> Column:
    """Why a path is rejected, the first reason of three; null if it is accepted."""
    reason = F.when(~extension(path).isin(*(e.lower().lstrip(".") for e in extensions)), K.NOT_ALLOWED).when(basename(path).rlike(glob_pattern(blocked)), K.BLOCKED)
    return F.when(ignored(path, rules), K.IGNORED).otherwise(reason) if rules else reason


def classify(df: DataFrame, path: str = "path", **options) -> DataFrame:
    return df.withColumn("reason", path_reason(F.col(path), **options))


def rejections(classified: DataFrame) -> DataFrame:
    """(reason, n) of what was rejected."""
    return classified.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def totals(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


def in_blocked_directory(path: Column, directories: Sequence[str] = K.BLOCKED_DIRECTORIES) -> Column:
    return path.rlike(f"(?:^|/)(?:{'|'.join(re.escape(d) for d in directories)})/")


def git_source(path: Column, extensions: Sequence[str] = K.GIT_EXTENSIONS) -> Column:
    """Whether a trimmed path ends in a source extension; case counts."""
    return trim(path).rlike(rf"\.(?:{'|'.join(extensions)})\z")


def code_file(path: Column, extensions: Sequence[str] = K.CODE_EXTENSIONS) -> Column:
    """Whether what follows the last dot of the whole path is a code extension; case counts."""
    return F.regexp_extract(path, r"\.([^.]+)\z", 1).isin(*extensions)


def relative(path: Column, folder: str) -> Column:
    """A path, absolute or from ``folder``, resolved and told from ``folder``: no empty, ``.`` or inner ``..`` parts."""
    base = [x for x in folder.split("/") if x]
    full = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/" + "/".join(base) + "/"), path)), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    def told(parts: Column) -> Column:
        shared = F.lit(0)
        for n in range(1, len(base) + 1):
            shared = F.when(F.slice(parts, 1, n) == F.array(*(F.lit(x) for x in base[:n])), n).otherwise(shared)
        return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.lit(len(base)) - shared), F.slice(parts, shared + 1, F.size(parts) + 1)), "/")

    return F.transform(F.array(F.aggregate(full, F.array().cast("array<string>"), step)), told)[0]


def accepted(classified: DataFrame, path: str = "path") -> DataFrame:
    """(path) of accepted files, by code point."""
    return classified.filter(F.col("reason").isNull()).select(path).orderBy(path)


def rejected(classified: DataFrame, path: str = "path") -> DataFrame:
    """(path, reason) of rejected files, in Unicode order."""
    return classified.filter(F.col("reason").isNotNull()).select(path, "reason").orderBy(F.collate(F.col(path), "UNICODE"), path)
