"""Progress of an audit's stages, observed while its result is worked out."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Say = Callable[[str], None]
#: Seconds without news after which no more metrics are waited for.
GRACE = 0.3


class Progress:
    """Counts of the rows that pass each watched stage, taken along by the job that reads them: there is no second pass.

    A stage has counts once an action has read its rows to their end. Where a plan reads a stage more than once, each reading counts the same rows and
    one of them is kept. ``quiet`` says nothing but counts all the same.
    """

    def __init__(self, quiet: bool = False, say: Say | None = None):
        self.quiet, self.say = quiet, say or logging.getLogger("auditloom").info
        self.stages: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **more: Column) -> DataFrame:
        """``df``, whose rows are counted as ``stage``; ``more`` are further aggregates by name."""
        if stage in self.stages:
            raise ValueError(f"stage {stage} is watched already")
        self.stages[stage] = Observation()
        return df.observe(self.stages[stage], F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in more.items()))

    def counts(self) -> dict[str, dict]:
        """What was counted, by stage; stages that no action has read are left out. Metrics come a moment after their action, so this waits until no more do."""
        ready = lambda: {stage for stage, o in self.stages.items() if o._jo is not None and o._jo.future().isCompleted()}
        last: set[str] | None = None
        while (now := ready()) != last and len(now) < len(self.stages):
            last = now
            time.sleep(GRACE)
        return {stage: got for stage, o in self.stages.items() if stage in ready() and (got := o.get)}

    def lines(self) -> list[str]:
        return [f"{stage}: " + ", ".join(f"{n} {v}" for n, v in got.items()) for stage, got in self.counts().items()]

    def report(self) -> None:
        """Says each stage's counts in a line, unless quiet."""
        if not self.quiet:
            for line in self.lines():
                self.say(line)
