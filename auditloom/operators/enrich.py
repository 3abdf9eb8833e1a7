"""Technology stacks and skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions.ecmascript import trim
from auditloom.sources import versioned


def tech_tokens(stack: Column) -> Column:
    """Lower-case names of more than two characters in a stack's description, version numbers taken off."""
    parts = F.split(F.regexp_replace(F.lower(stack), r"[()]", " "), r"[,\s]+")
    long = F.filter(F.transform(parts, trim), lambda x: F.length(x) > 2)
    bare = F.transform(long, lambda x: trim(F.regexp_replace(x, r"\d+(\.\d+)?", "")))
    return F.filter(bare, lambda x: x != "")


def skills_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), ",")


def skills_file(key: Column) -> Column:
    return F.regexp_replace(key, "(?i)[^a-z0-9]", "_")


def usable_skills(df: DataFrame) -> DataFrame:
    """(position, skill, category, prompt, relevance) with fields filled from their stand-ins; rows without a name go."""
    col = lambda *names: [F.col(n) for n in names if n in df.columns]
    out = df.select("position", F.coalesce(*col("skill", "name"), F.lit("")).alias("skill"), F.coalesce(*col("category"), F.lit("general")).alias("category"), F.coalesce(*col("prompt", "description"), F.lit("")).alias("prompt"), F.coalesce(*col("relevance"), F.lit(1.0)).alias("relevance"))
    return out.filter(F.col("skill") != "")


def top_skills(df: DataFrame, n: int = K.SKILLS_TOP) -> DataFrame:
    """The n most relevant skills, earlier ones first among equals, with their rank and cut prompt."""
    best = df.withColumn("relevance", F.coalesce("relevance", F.lit(0.0))).orderBy(F.desc("relevance"), "position").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("relevance"), "position"))  # over at most n rows
    return best.withColumn("rank", rank).withColumn("prompt", F.substring(trim(F.col("prompt")), 1, K.SKILL_CHARS))


def skills_section(top: DataFrame) -> DataFrame:
    """(category, first, text): prompts of each category as list lines, categories in order of their best skill; blank prompts left out."""
    line = F.when(F.col("prompt") != "", F.concat(F.lit("- "), F.col("prompt")))
    rows = top.groupBy("category").agg(F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    lines = F.filter(F.transform("rows", lambda x: x["line"]), lambda x: x.isNotNull())
    return rows.select("category", "first", F.array_join(F.concat(F.array(F.concat(F.lit("### "), F.col("category"))), lines), "\n").alias("text"))


def fresh(stamp_ms: Column, now_ms: Column, ttl_ms: int = K.SKILLS_TTL_MS) -> Column:
    return now_ms - stamp_ms < ttl_ms


def store_skills(skills: DataFrame, path: str, key: str, now_ms: int) -> None:
    """Stores the skills found for a stack with the time they were read; they replace those stored for it before."""
    versioned.upsert(skills.withColumn("key", F.lit(key)).withColumn("timestamp", F.lit(now_ms).cast("long")), path, stamp="timestamp")


def stored_skills(spark: SparkSession, path: str, key: str, now_ms: int) -> DataFrame | None:
    """The latest skills stored for a stack, no rows if they aren't fresh; None where nothing was stored at all."""
    stored = versioned.current(spark, path)
    return stored if stored is None else stored.filter(F.col("key") == key).filter(fresh(F.col("timestamp"), F.lit(now_ms))).drop("key", "timestamp")


def compact_skills(spark: SparkSession, path: str, now_ms: int, ttl_ms: int = K.SKILLS_TTL_MS) -> None:
    """Rewrites the store without what isn't fresh any more."""
    versioned.compact(spark, path, now_ms - ttl_ms + 1)
