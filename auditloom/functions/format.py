"""Sizes and durations for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(size: Column) -> Column:
    """Two decimals at most, zeros at their end dropped; over 1024 GB in TB."""
    out = F.lit("0 B")
    for i, unit in enumerate(UNITS):
        shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", size / float(1024**i)), r"0+\z", ""), r"\.\z", "")
        out = F.when(size >= 1024**i, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def _tenths(seconds: Column) -> Column:
    """One decimal of a double from 1 to 60, rounded on its exact binary value, ties up: such a double times 2**52 is a whole number."""
    n = F.shiftright((seconds * float(1 << 52)).cast("long") * 10 + (1 << 51), 52)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def format_duration(ms: Column) -> Column:
    """Nms, N.Ns or Mm Ss. A rest of 59.5 s or more shows as 60s, and a rest of 0 s isn't shown."""
    minutes, rest = F.floor(ms / 60_000).cast("long"), F.floor((ms % 60_000) / 1000 + 0.5).cast("long")
    long = F.concat(minutes.cast("string"), F.lit("m"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("s"))).otherwise(F.lit("")))
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(_tenths(ms.cast("double") / 1000), F.lit("s"))).otherwise(long)
