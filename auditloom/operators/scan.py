"""Line scans and payload summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import constants as K
from auditloom.functions.ecmascript import trim


def suspicious_lines(df: DataFrame, keywords: Sequence[str] = K.KEYWORDS, path: str = "path", content: str = "content") -> DataFrame:
    """(path, keyword, line, context): the first keyword, in list order, of each line that has one."""
    lines = df.select(path, F.posexplode(F.split(content, "\n")).alias("at", "text"))
    lower = F.lower("text")
    first = F.coalesce(*(F.when(F.contains(lower, F.lit(k)), F.lit(k)) for k in keywords))
    number = (F.col("at") + 1).cast("long")
    context = F.concat(F.col(path), F.lit(":"), number.cast("string"), F.lit(" → "), F.substring(trim(F.col("text")), 1, K.CONTEXT_CHARS))
    return lines.withColumn("keyword", first).filter(F.col("keyword").isNotNull()).select(path, "keyword", number.alias("line"), context.alias("context"))


def payload_summary(df: DataFrame, content: str = "content") -> DataFrame:
    """One row: files, characters, and tokens as a quarter of all characters, rounded up once."""
    chars = F.coalesce(F.sum(F.length(content)), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("files"), chars.alias("chars"), F.ceil(chars / 4.0).cast("long").alias("tokens"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("long").alias("bytes"))
