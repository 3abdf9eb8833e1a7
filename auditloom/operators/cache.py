"""Result cache keyed by everything a verdict depends on."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.verdict import parse_verdicts
from auditloom.sources import versioned

CACHE_VERSION = "1"
FIELDS = ("version", "provider", "model", "prompt_version", "tool_version", "file_path", "system_prompt", "payload")


def cache_key(fields: list[Column]) -> Column:
    """SHA-256 of the eight fields in order; null counts as empty."""
    return F.sha2(F.concat_ws("::", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def look_up(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses). hits carry a verdict read anew from the stored JSON; unreadable entries are misses, stored bad statuses are hits."""
    read = parse_verdicts(cache.select(key, "json"), "json").filter(~F.col("verdict.message").eqNullSafe(F.lit("Failed to parse AI response")))
    return requests.join(read.select(key, "verdict"), key), requests.join(read.select(key), key, "left_anti")


def new_entries(results: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Entries to append: results that are no errors and not stored yet."""
    return results.filter(F.col("status") != "ERROR").join(cache.select(key), key, "left_anti")


SCHEMA = "key string, json string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, json) stored below ``path``, a row a key; empty where nothing was stored yet."""
    stored = versioned.current(spark, path)
    return spark.createDataFrame([], SCHEMA) if stored is None else stored.select("key", "json")


def write(results: DataFrame, path: str, key: str = "key", verdict: str = "verdict", now_ms: int | None = None) -> None:
    """Stores each verdict that is no error as JSON, once a key: a later write replaces an earlier one, whoever wrote it."""
    stamp = F.lit(int(time.time() * 1000) if now_ms is None else now_ms).cast("long")
    rows = results.filter(F.col(f"{verdict}.status") != "ERROR").select(F.col(key).alias("key"), F.to_json(F.col(verdict)).alias("json"), stamp.alias("stamp"))
    versioned.upsert(rows.dropDuplicates(["key"]), path)


def compact(spark: SparkSession, path: str, now_ms: int, ttl_ms: int) -> None:
    """Rewrites the store without entries of ``ttl_ms`` or older."""
    versioned.compact(spark, path, now_ms - ttl_ms + 1)
