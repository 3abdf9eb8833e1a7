"""Reports: severities, statuses, summaries, rows and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions.format import format_duration

SCHEMA_VERSION = "1.0"


def issue_rows(results: DataFrame, key: str = "path") -> DataFrame:
    """A row an issue: (key, position, line, severity, message, suggestion)."""
    return results.select(key, F.posexplode("issues").alias("position", "i")).select(key, F.col("position").cast("long").alias("position"), "i.*")


def _severities(issues: str = "issues") -> dict[str, Column]:
    return {s.lower(): F.coalesce(F.sum(F.size(F.filter(issues, _severity(s)))), F.lit(0)).cast("long") for s in K.SEVERITIES}


def _severity(name: str):
    return lambda x: x["severity"] == name


def severity_counts(results: DataFrame) -> DataFrame:
    """One row: critical, warning, info; zeros without results."""
    return results.agg(*(c.alias(n) for n, c in _severities().items()))


def summary(results: DataFrame, runtime_errors: int = 0) -> DataFrame:
    """One row: audited, passed, failed (all that didn't pass), severities, status and exit code.

    ERROR if anything went wrong; FAIL on a failed result or a critical or warning issue; infos never fail.
    """
    counts = _severities()
    row = results.agg(F.count("*").alias("audited"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") != "PASS").alias("failed"), *(c.alias(n) for n, c in counts.items()), F.count_if(F.col("status") == "ERROR").alias("errors"), F.count_if(F.col("status") == "FAIL").alias("fails"))
    status = F.when((F.col("errors") > 0) | F.lit(runtime_errors > 0), "ERROR").when((F.col("fails") > 0) | (F.col("critical") > 0) | (F.col("warning") > 0), "FAIL").otherwise("PASS")
    return row.withColumn("status", status).drop("errors", "fails").withColumn("exit_code", exit_code(F.col("status")))


def exit_code(status: Column) -> Column:
    return F.when(status == "PASS", 0).when(status == "FAIL", 1).otherwise(2)


def report_row(results: DataFrame, inputs: DataFrame, skipped: DataFrame, duration_ms: float = 0.0) -> DataFrame:
    """One row of totals: results, skipped and changed lines together. The three inputs are one-row aggregates by then."""
    changed = inputs.agg(F.coalesce(F.sum("changed_lines"), F.lit(0)).cast("long").alias("changed_lines"))
    left_out = skipped.agg(F.count("*").alias("skipped"))
    one = lambda df: df.withColumn("one", F.lit(1))
    row = one(summary(results)).join(one(changed), "one").join(one(left_out), "one").drop("one")
    return row.withColumn("total_files", F.col("audited") + F.col("skipped")).withColumn("duration_ms", F.lit(float(duration_ms)))


def legacy_summary(results: DataFrame) -> DataFrame:
    """One row: PASS, FAIL and ERROR results, files with a critical issue; passed without critical files and system errors.

    A result that failed without issues is a system error.
    """
    critical = F.exists("issues", _severity("CRITICAL"))
    broken = F.col("status").isin("FAIL", "ERROR") & (F.size("issues") == 0)
    row = results.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in K.STATUSES), F.count_if(critical).alias("critical_files"), F.count_if(broken).alias("system_errors"))
    return row.withColumn("passed", (F.col("critical_files") == 0) & (F.col("system_errors") == 0))


def union_skips(rejected: DataFrame, skipped: DataFrame) -> DataFrame:
    """(stage, path, reason): rejected paths, then what guardrails skipped."""
    part = lambda df, n: df.select(F.lit(n).alias("stage"), "path", "reason")
    return part(rejected, 1).unionByName(part(skipped, 2))


def json_report(row: DataFrame) -> DataFrame:
    """(json): the one-row report; absent values are left out."""
    return row.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), *row.columns), {"pretty": "true"}).alias("json"))


def failed(results: DataFrame) -> DataFrame:
    """Results that are listed in reports: failures and errors."""
    return results.filter(F.col("status").isin("FAIL", "ERROR"))


def commentable(results: DataFrame) -> DataFrame:
    """Results whose issues are posted as comments: failures that have some."""
    return results.filter((F.col("status") == "FAIL") & (F.size("issues") > 0))


def run_code(exceeded: Column, files: Column, status: Column) -> Column:
    """The exit code of a run: 0 if there was nothing to review, 2 if its tokens passed the limit, else its status'."""
    return F.when(files == 0, 0).when(exceeded, 2).otherwise(exit_code(status))


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _whole(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def _lines(report: DataFrame, skipped: DataFrame, results: DataFrame, errors: DataFrame | None, head: list[Column], left_out: tuple[list[Column], Column], titles: tuple[str | None, Column, Column, Column], broken: tuple[str, Column]) -> DataFrame:
    """(part, key, position, line): the lines of a report by part, path and position. Only the header comes from one row; the rest stays distributed."""
    bad = failed(results)
    title, name, issue, without = titles
    row = lambda df, part, key, position, line: df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), position.cast("long").alias("position"), line.alias("line"))
    out = row(report.select(F.posexplode(F.array(*head)).alias("i", "l")), 1, F.lit(""), F.col("i"), F.col("l"))
    note, entry = left_out
    has = lambda df: df.agg(F.count("*").alias("n")).filter("n > 0")
    out = out.unionByName(row(has(skipped).select(F.posexplode(F.array(*note)).alias("i", "l")), 2, F.lit(""), F.col("i"), F.col("l")))
    out = out.unionByName(row(skipped, 3, F.col("path"), F.lit(0), entry))
    if title:
        out = out.unionByName(row(has(bad), 4, F.lit(""), F.lit(0), F.lit(title)))
    out = out.unionByName(row(bad, 5, F.col("path"), F.lit(-1), name))
    out = out.unionByName(row(issue_rows(bad), 5, F.col("path"), F.col("position"), issue))
    out = out.unionByName(row(bad.filter(F.coalesce(F.size("issues"), F.lit(0)) < 1), 5, F.col("path"), F.lit(0), without))
    if errors is not None:
        heading, line = broken
        out = out.unionByName(row(has(errors), 6, F.lit(""), F.lit(0), F.lit(heading))).unionByName(row(errors, 7, F.col("error"), F.lit(0), line))
    return out


def _message(results: DataFrame) -> Column:
    said = F.nullif(F.col("message"), F.lit("")) if "message" in results.columns else F.lit(None).cast("string")
    return F.coalesce(said, F.lit(K.UNKNOWN_ERROR))


def _target(mode: str, value: str, before: str, after: str = "") -> str:
    return f"{mode}{before}{value}{after}" if value else mode


def _metrics(duration: Column) -> list[Column]:
    c = F.col
    return [c("total_files"), c("audited"), c("passed"), c("failed"), c("critical"), c("warning"), c("info"), duration, c("changed_lines")]


def markdown_lines(report: DataFrame, skipped: DataFrame, results: DataFrame, errors: DataFrame | None = None, mode: str = "files", value: str = "", ai: bool = False, at: str = "") -> DataFrame:
    """(part, key, position, line) of the Markdown report; ``text`` joins them."""
    c = F.col
    title, status, target, enabled, made, *table = K.MARKDOWN_HEAD
    rows = [_text(f"| {n} | ", v, " |") for n, v in zip(K.MARKDOWN_METRICS, _metrics(F.floor(c("duration_ms") + 0.5)), strict=True)]
    head = [F.lit(title), _text(status, c("status"), "**"), F.lit(f"{target}{_target(mode, value, ':')}`"), F.lit(f"{enabled}{str(ai).lower()}`"), F.lit(f"{made}{at}`"), *map(F.lit, table), *rows]
    hint = F.coalesce(F.concat(F.lit(" — _"), F.nullif(c("suggestion"), F.lit("")), F.lit("_")), F.lit(""))
    issue = _text("- **", c("severity"), "** (line ", _whole(c("line")), "): ", c("message"), hint)
    left_out, findings, broken = K.MARKDOWN_PARTS
    titles = (findings, _text("### `", c("path"), "`"), issue, _text("- **ERROR**: ", _message(results)))
    return _lines(report, skipped, results, errors, head, ([F.lit(left_out)], _text("- `", c("path"), "`: ", c("reason"))), titles, (broken, _text("- ", c("error"))))


def console_lines(report: DataFrame, skipped: DataFrame, results: DataFrame, errors: DataFrame | None = None, mode: str = "files", value: str = "", ai: bool = False) -> DataFrame:
    """(part, key, position, line) of the console report; ``text`` joins them."""
    c = F.col
    icon = F.when(c("status") == "PASS", "✅").when(c("status") == "FAIL", "❌").otherwise("💥")
    title, status, target, enabled = K.CONSOLE_HEAD
    rows = [_text(f"   {n}", v) for n, v in zip(K.CONSOLE_METRICS, _metrics(format_duration(c("duration_ms"))), strict=True)]
    head = [F.lit(title), _text(status, icon, " ", c("status")), F.lit(f"{target}{_target(mode, value, ' (', ')')}"), F.lit(f"{enabled}{'yes' if ai else 'no'}"), *rows]
    hint = F.coalesce(F.concat(F.lit("\n💡 "), F.nullif(c("suggestion"), F.lit(""))), F.lit(""))
    issue = _text("[", c("severity"), "] line ", _whole(c("line")), ": ", c("message"), hint)
    marker = F.when(c("status") == "ERROR", "💥").otherwise("❌")
    cached = F.when(c("cached"), " (cached)").otherwise("") if "cached" in results.columns else F.lit("")
    titles = (None, _text(marker, " ", c("path"), cached), issue, _message(results))
    return _lines(report, skipped, results, errors, head, ([_text("Skipped ", c("n"), " file(s):")], _text(c("path"), ": ", c("reason"))), titles, ("Runtime errors:", c("error")))


def text(lines: DataFrame) -> str:
    """The lines in order, as one string, for a report short enough to read; a blank line before each part and each file's findings."""
    out: list[str] = []
    last = None
    for r in lines.orderBy("part", "key", "position").toLocalIterator():
        new = r["line"].startswith("## ") or r["line"] == "| Metric | Value |" or (r["part"] in (2, 4, 6) and r["part"] != last) or (r["part"] == 5 and r["position"] < 0)
        out += ["", r["line"]] if out and new else [r["line"]]
        last = r["part"]
    return "\n".join(out).rstrip() + "\n"
