"""Diffs: synthetic patches, line counts, reasons to skip, truncation and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from auditloom import constants as K
from auditloom.functions.ecmascript import trim
from auditloom.operators.rank import ranked


def synthetic_diff(path: Column, content: Column, most: int = K.SYNTHETIC_LINES) -> Column:
    """A patch that adds the first ``most`` lines of a file."""
    lines = F.slice(F.split(content, "\n"), 1, most)
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"))
    return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"))


def patch_or_synthetic(patch: Column, path: Column, content: Column) -> Column:
    """The patch, or where it is null or blank one that adds the file."""
    return F.when(F.length(trim(patch)) > 0, patch).otherwise(synthetic_diff(path, content))


def line_counts(patch: Column) -> tuple[Column, Column]:
    """(additions, deletions); file headers, lines of three signs and a space, count as neither."""
    lines = F.split(patch, "\n")
    plus = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++ ")))
    minus = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("--- ")))
    return plus.cast("long"), minus.cast("long")


def skip_reason(patch: Column) -> Column:
    """Why a patch isn't audited; null if it is."""
    plus, minus = line_counts(patch)
    binary = F.contains(patch, F.lit("Binary files ")) | F.contains(patch, F.lit("GIT binary patch"))
    return F.when(F.length(trim(patch)) == 0, K.NO_DIFF).when(binary, K.BINARY).when(plus + minus == 0, K.NO_CHANGE)


def truncate(patch: Column, most: int = K.MAX_CHARS_PER_FILE, mark: str = K.TRUNCATED) -> Column:
    """The first ``most`` code points and a mark, if there are more."""
    return F.when(F.length(patch) > most, F.concat(F.substring(patch, 1, most), F.lit(mark))).otherwise(patch)


def cap_files(df: DataFrame, most: int = K.MAX_FILES, path: str = "path", by: str | None = None, positions: bool = True) -> DataFrame:
    """Distinct paths in Unicode order; those after the first ``most`` (of each ``by``) get a reason.

    With ``by``, ranks are per group. Without it the order is over all paths: positions come from ranges of paths, dealt over the tasks, and
    the counts before them. Where ``positions`` isn't asked for, only the first ``most`` get one: a top-N finds them, and they are marked by
    a join with these ``most`` rows, without a shuffle of the others.
    """
    order = F.collate(F.col(path), "UNICODE"), F.col(path)
    reason = F.lit(f"Skipped by maxFiles guardrail ({most})")
    if by:
        window = Window.partitionBy(by).orderBy(*order)
        return df.select(by, path).distinct().withColumn("position", F.row_number().over(window)).withColumn("reason", F.when(F.col("position") > most, reason))
    paths = df.select(path).distinct()
    if positions:
        return ranked(paths, *order).withColumn("reason", F.when(F.col("position") > most, reason))
    first = paths.orderBy(*order).limit(most).agg(F.collect_list(F.struct(F.col(path).alias("p"))).alias("all"))
    first = first.select(F.posexplode(F.array_sort("all", lambda a, b: _compared(a["p"], b["p"]))).alias("at", "s")).select(F.col("s.p").alias("_first"), (F.col("at") + 1).cast("long").alias("position"))
    return paths.join(F.broadcast(first), F.col(path).eqNullSafe(F.col("_first")), "left").drop("_first").withColumn("reason", F.when(F.col("position").isNull(), reason))


def _compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by Unicode order, then by bytes; nulls first."""
    x, y = F.collate(a, "UNICODE"), F.collate(b, "UNICODE")
    return F.when(a.isNull(), -1).when(b.isNull(), 1).when(x < y, -1).when(x > y, 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def budget(df: DataFrame, by: str, position: str, changed: str, most: int = K.MAX_DIFF_LINES) -> DataFrame:
    """Greedy fold in order of ``position``: a file that would exceed the budget is skipped, later ones may fit.

    Groups are sorted and streamed past a running total, so no group is ever held whole. Equal positions go by fewer changes
    first; a null change counts as none. Returns (by, position, changed, kept, total after it).
    """
    rows = df.select(F.col(by).alias("by"), F.col(position).cast("long").alias("position"), F.coalesce(F.col(changed).cast("long"), F.lit(0)).alias("changed"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = object(), 0
        for batch in batches:
            kept, totals = [], []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != group:
                    group, total = key, 0
                kept.append(total + n <= most)
                total += n if kept[-1] else 0
                totals.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_()), pa.array(totals, pa.int64())], names=["by", "position", "changed", "kept", "total"])

    schema = StructType([rows.schema["by"], *(StructField(n, LongType()) for n in ("position", "changed")), StructField("kept", BooleanType()), StructField("total", LongType())])
    return rows.repartition("by").sortWithinPartitions("by", "position", "changed").mapInArrow(fold, schema).withColumnRenamed("by", by)
