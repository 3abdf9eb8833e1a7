"""The whole audit as one plan over (path, content) or (path, patch) rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.config import Config, system_prompt
from auditloom.operators import classify, diff, provider, redact, report, tokens
from auditloom.operators.progress import Progress


@dataclass(frozen=True)
class Review:
    """Lazy frames of an audit. ``inputs`` is what passed the guardrails, redacted."""

    inputs: DataFrame
    skipped: DataFrame
    redactions: DataFrame
    results: DataFrame
    report: DataFrame


def review(patches: DataFrame, config: Config | None = None, ignore: str = "", providers: Sequence[provider.Provider] = (), name: str = "", progress: Progress | None = None) -> Review:
    """Classify, cap, filter, fold, truncate, redact, judge, report. Without providers the verdicts are the redactions'.

    Cheap path tests come first, so patches of rejected paths are never looked at; text is redacted whoever reads it afterwards.
    ``progress`` counts the rows of each stage while the report, or any of the frames, is worked out.
    """
    watch = progress.watch if progress else lambda df, *_, **__: df
    config = (config or Config()).floors()
    listed = watch(classify.classify(patches.select("path").distinct(), rules=classify.ignore_rules(ignore)), "listed", rejected=F.count_if(F.col("reason").isNotNull()))
    rejected = listed.filter(F.col("reason").isNotNull())
    capped = diff.cap_files(listed.filter(F.col("reason").isNull()), config.ai.max_files, positions=False)
    capped = watch(capped, "capped", skipped=F.count_if(F.col("reason").isNotNull()))
    kept = patches.join(capped.filter(F.col("reason").isNull()).select("path", "position"), "path")
    plus, minus = diff.line_counts(F.col("patch"))
    looked = kept.withColumn("reason", diff.skip_reason(F.col("patch"))).withColumn("changed_lines", plus + minus)
    looked = watch(looked, "patches", skipped=F.count_if(F.col("reason").isNotNull()), changed_lines=F.coalesce(F.sum("changed_lines"), F.lit(0)))
    fine = looked.filter(F.col("reason").isNull())
    folded = diff.budget(fine.withColumn("all", F.lit(1)), "all", "position", "changed_lines", config.ai.max_diff_lines).select("position", "kept")
    judged = watch(fine.join(folded, "position"), "budget", skipped=F.count_if(~F.col("kept")))
    over = judged.filter(~F.col("kept")).select("path", F.lit(f"Skipped by maxDiffLines guardrail ({config.ai.max_diff_lines})").alias("reason"))
    skipped = report.union_skips(rejected, capped.filter(F.col("reason").isNotNull()).select("path", "reason").unionByName(looked.filter(F.col("reason").isNotNull()).select("path", "reason")).unionByName(over))
    inputs = redact.redact(judged.filter("kept").select("path", diff.truncate(F.col("patch"), config.ai.max_chars_per_file).alias("content"), "changed_lines"))
    inputs = watch(inputs, "redacted", redactions=F.coalesce(F.sum("redacted_count"), F.lit(0)))
    found = redact.redaction_rows(inputs).select("path", "redacted_count", "matched_patterns")
    results = provider.audit(inputs, providers, system_prompt(config), config.max_concurrency) if providers else redact.security_results(inputs, found)
    results = watch(results, "results", **{s.lower(): F.count_if(F.col("status") == s) for s in K.STATUSES})
    return Review(inputs, skipped, found, results, report.report_row(results, inputs, skipped))


def token_gate(inputs: DataFrame, prompt: str = "", name: str = "", override: int | None = None, count: tokens.Counter | None = None) -> DataFrame:
    """One row: total of the inputs' tokens and the prompt's, the provider's limit, and what the gate says.

    Tokens are estimates, or with ``count`` (such as ``tokens.RankCounter``) exact.
    """
    said = inputs.withColumn("tokens", tokens.estimate(F.col("content"), count))
    total = said.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).withColumn("total", F.col("total") + (tokens.estimate(F.lit(prompt)) if count is None else F.lit(count([prompt])[0])))
    most = tokens.limit(F.lit(name), F.lit(override) if override else None)
    return total.withColumn("limit", most).withColumn("gate", tokens.gate(F.col("total"), F.col("limit"))).withColumn("percent", tokens.percent(F.col("total"), F.col("limit")))
