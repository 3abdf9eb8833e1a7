"""Ranks and caps over a whole table, without a window that one task would have to sort."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.sources.store import save

#: Row numbers within a partition take this many bits of what ``monotonically_increasing_id`` gives.
BITS = 33


def ranked(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """Adds ``name``: 1, 2, 3, ... in ``order`` over all rows.

    Rows are dealt by ranges of ``order``, sorted within partitions and written; a row's rank is its number there plus the rows of the
    partitions before. Only those counts, one a partition, come to the driver and go out again. Rows that are equal in all of
    ``order`` meet in one partition and get different ranks, in any order. The sampling of ranges reads ``df`` once more, so it should be a
    saved table or end in a shuffle.
    """
    placed = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", BITS)
    sizes = dict(sorted(map(tuple, placed.groupBy(part.alias("_part")).count().collect())))
    before = dict(zip(sizes, accumulate(sizes.values(), initial=0), strict=False))
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << BITS) - 1) + 1
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*df.columns, rank.alias(name))
