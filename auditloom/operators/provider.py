"""Model providers behind a callable: retries, fallbacks, errors as rows."""

from __future__ import annotations

import itertools
import os
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions.ecmascript import trim
from auditloom.operators.verdict import VERDICT, _error, parse

#: (system prompt, user prompt) to text.
Provider = Callable[[str, str], str]
KNOWN = ("gemini", "openai", "anthropic")


class ProviderError(RuntimeError):
    """A provider that isn't known or has no key."""


@dataclass(frozen=True)
class Settings:
    """What a provider is made from."""

    provider: str
    model: str
    api_key: str
    temperature: float = 0.2
    max_tokens: int = 2048

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None, provider: str | None = None) -> Settings:
        """From AI_PROVIDER, AI_MODEL, AI_TEMPERATURE, AI_MAX_TOKENS and <PROVIDER>_API_KEY. ``provider`` asks for a fallback, with its default model."""
        env = os.environ if env is None else env
        name = provider or env.get("AI_PROVIDER", "").lower() or KNOWN[0]
        if name not in K.DEFAULT_MODELS:
            raise ProviderError(f"Unsupported AI provider: {name}")
        variable = f"{name.upper()}_API_KEY"
        if not env.get(variable):
            raise ProviderError(f"No API key for {name}: set {variable}")
        model = (None if provider else env.get("AI_MODEL")) or K.DEFAULT_MODELS[name]
        return cls(name, model, env[variable], float(env.get("AI_TEMPERATURE") or 0.2), int(env.get("AI_MAX_TOKENS") or 2048))


def make(settings: Settings, makers: Mapping[str, Callable[[Settings], Provider]]) -> Provider:
    """The provider that the settings name, from makers by name; raises if there is none."""
    if settings.provider not in makers:
        raise ProviderError(f"Unsupported AI provider: {settings.provider}")
    return makers[settings.provider](settings)


def commit_message_prompt(message: Column) -> Column:
    return F.concat(F.lit('Commit Message: "'), message, F.lit('"'))


def file_prompt(content: Column) -> Column:
    return F.concat(F.lit("Code to review:\n"), content)


def retryable(name: str, message: str) -> bool:
    return name == "AbortError" or any(x in message for x in ("429", "503", "ECONNRESET"))


def retryable_column(name: Column, message: Column) -> Column:
    return (name == "AbortError") | message.rlike("429|503|ECONNRESET")


def retry_delay(attempt: Column, jitter: Column) -> Column:
    """Milliseconds before an attempt's successor; jitter from 0 to 1."""
    return F.least(K.RETRY_BASE_MS * F.pow(F.lit(2.0), attempt - 1) + jitter * K.RETRY_JITTER_MS, F.lit(float(K.RETRY_CAP_MS)))


def fallbacks(text: str) -> list[str]:
    """Known provider names in a list, order and repeats kept."""
    return [x for x in (p.strip().lower() for p in text.split(",")) if x in KNOWN]


def fallbacks_column(text: Column) -> Column:
    """``fallbacks`` of a column."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(trim(x))), lambda x: x.isin(*KNOWN))


def call(provider: Provider, system: str, user: str, attempts: int = K.RETRY_ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(1, attempts + 1):
        try:
            return provider(system, user)
        except Exception as e:
            if attempt == attempts or not retryable(type(e).__name__, str(e)):
                raise
            sleep(min(K.RETRY_BASE_MS * 2 ** (attempt - 1) + random.random() * K.RETRY_JITTER_MS, K.RETRY_CAP_MS) / 1000)
    raise AssertionError


def ask(providers: Sequence[Provider], system: str, user: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The first provider's verdict; after a retryable failure the others' in order; an ERROR verdict if none answers."""
    first: Exception | None = None
    for provider in providers:
        try:
            return parse(call(provider, system, user, sleep=sleep))
        except Exception as e:  # any failure of a provider becomes a row, never a lost task
            first = first or e
            if not retryable(type(first).__name__, str(first)):
                break
    return _error(f"Audit failed: {first}")


def audit(files: DataFrame, providers: Sequence[Provider], system: str, concurrency: int | None = None, position: str | None = None) -> DataFrame:
    """(path, verdict, duration): each file's verdict. ``concurrency`` bounds how many tasks call at once.

    With ``position``, a column that counts files from 0, files are judged in consecutive groups of ``concurrency``, and a group is begun
    when the one before has ended.
    """
    rows = files.select("path", file_prompt(F.coalesce("content", F.lit(""))).alias("prompt"), *_at(position))
    return _judged(rows, "path", "path string", providers, system, concurrency, position is not None)


def audit_commits(commits: DataFrame, providers: Sequence[Provider], system: str, concurrency: int | None = None, position: str | None = None) -> DataFrame:
    """(hash, verdict, duration): each commit message's verdict; ``system`` is ``config.commit_prompt``'s. ``position`` as for ``audit``."""
    rows = commits.select("hash", commit_message_prompt(F.coalesce("message", F.lit(""))).alias("prompt"), *_at(position))
    return _judged(rows, "hash", "hash string", providers, system, concurrency, position is not None)


def _at(position: str | None) -> list[Column]:
    return [F.col(position).cast("long").alias("at")] if position else []


def _in_groups(rows: DataFrame, key: str, field: str, providers: Sequence[Provider], system: str, concurrency: int) -> DataFrame:
    """Verdicts group after group, in Spark's barrier mode: each task judges its share of a group and waits for the others.

    There are as many tasks as a group has members, or as cores if those are fewer; then a task judges several members at once, in threads.
    A lost task has the whole stage run again, as barrier mode knows no other way. Rows of no position are judged in the first group.
    """
    tasks = max(1, min(concurrency, rows.sparkSession.sparkContext.defaultParallelism))
    rows = rows.withColumn("at", F.coalesce("at", F.lit(0).cast("long")))
    last = rows.agg(F.max("at")).first()[0]
    groups = 0 if last is None else last // concurrency + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        mine = itertools.groupby(zip_rows(batches), lambda row: row[2] // concurrency)
        group, members = next(mine, (groups, iter(())))

        def judge(row: tuple) -> dict:
            began = time.monotonic()
            verdict = ask(providers, system, row[1])
            return {key: row[0], **verdict, "duration": (time.monotonic() - began) * 1000}

        with ThreadPoolExecutor(-(-concurrency // tasks)) as pool:
            for now in range(groups):
                if group == now:
                    yield pd.DataFrame(list(pool.map(judge, members)), columns=[key, "status", "message", "suggestion", "issues", "duration"])
                    group, members = next(mine, (groups, iter(())))
                context.barrier()

    def zip_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch[key], batch["prompt"], batch["at"], strict=True)

    dealt = rows.repartitionById(tasks, (F.col("at") % concurrency % tasks).cast("int")).sortWithinPartitions("at")
    return dealt.mapInPandas(run, f"{field}, {VERDICT}, duration double", barrier=True)


def _judged(rows: DataFrame, key: str, field: str, providers: Sequence[Provider], system: str, concurrency: int | None, in_groups: bool) -> DataFrame:
    if in_groups:
        return _in_groups(rows, key, field, providers, system, concurrency or 1)
    rows = rows.repartition(concurrency) if concurrency else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, prompt in zip(batch[key], batch["prompt"], strict=True):
                began = time.monotonic()
                verdict = ask(providers, system, prompt)
                out.append({key: name, **verdict, "duration": (time.monotonic() - began) * 1000})
            yield pd.DataFrame(out, columns=[key, "status", "message", "suggestion", "issues", "duration"])

    return rows.mapInPandas(run, f"{field}, {VERDICT}, duration double")


def batches(df: DataFrame, size: int, position: str) -> DataFrame:
    """Adds batch: consecutive groups of ``size`` by a position that counts from 0."""
    return df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))


def first_answer(*answers: Column) -> Column:
    """The first provider that answered, as columns."""
    return F.coalesce(*answers)
