"""A list of preparation steps, replayed on the source plan. Undo is dropping the last step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.quality import Audit


@dataclass(frozen=True)
class Step:
    """A named transformation of the working table."""

    kind: str
    description: str
    apply: Callable[[DataFrame], DataFrame]
    column: str = "Dataset"
    strategy: str = ""
    reason: str = ""


@dataclass(frozen=True)
class Preparation:
    source: DataFrame
    steps: tuple[Step, ...] = field(default=())

    def then(self, step: Step) -> "Preparation":
        return replace(self, steps=(*self.steps, step))

    def undo(self) -> "Preparation":
        return replace(self, steps=self.steps[:-1])

    def stages(self) -> list[DataFrame]:
        """The source and the table after each step, all lazy."""
        tables = [self.source]
        for step in self.steps:
            tables.append(step.apply(tables[-1]))
        return tables

    def result(self) -> DataFrame:
        return self.stages()[-1]

    def log(self, scores: bool = False) -> DataFrame:
        """One row per step: sizes before and after and, on request, the change of the quality score."""
        tables = self.stages()
        spark = self.source.sparkSession
        rows = [t.agg(F.count(F.lit(1))).scalar() for t in tables]
        quality = [Audit(t, share=False).score() for t in tables] if scores else None
        entries = []
        for i, step in enumerate(self.steps):
            delta = F.round(quality[i + 1] - quality[i], 1) if quality else F.lit(0.0)
            entries.append(
                spark.range(1).select(
                    F.lit(i + 1).alias("step"),
                    F.lit(step.kind).alias("type"),
                    F.lit(step.description).alias("description"),
                    F.lit(step.column).alias("column"),
                    F.lit(step.strategy).alias("strategy"),
                    F.lit(step.reason).alias("reason"),
                    rows[i].alias("rows_before"),
                    rows[i + 1].alias("rows_after"),
                    F.lit(len(tables[i].columns)).alias("columns_before"),
                    F.lit(len(tables[i + 1].columns)).alias("columns_after"),
                    delta.alias("score_delta"),
                )
            )
        return reduce(DataFrame.unionByName, entries)
