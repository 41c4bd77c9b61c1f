"""A chain of gates that keeps account of itself.

Gates are columns over one frame. Every row gets the number of gates it passes before it
first fails, so the funnel of all stages is one aggregate, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.statistics import stage_statistics


class Pipeline:
    def __init__(self, rows: DataFrame, first: str = "raw") -> None:
        self.rows, self.names, self.gates = rows, [first], []

    def gate(self, name: str, keep: Column) -> Pipeline:
        """A further stage; null doesn't pass."""
        self.names.append(name)
        self.gates.append(F.coalesce(keep, F.lit(False)))
        return self

    def _passed(self) -> Column:
        passed = F.lit(len(self.gates))
        for k in range(len(self.gates) - 1, -1, -1):
            passed = F.when(self.gates[k], passed).otherwise(F.lit(k))
        return passed

    def kept(self, stage: str | None = None) -> DataFrame:
        """Rows that reach a stage, the last one by default."""
        at = self.names.index(stage) if stage else len(self.gates)
        return self.rows.filter(self._passed() >= at)

    def dropped(self) -> DataFrame:
        """Rows that don't reach the end, with the gate that stopped them."""
        names = F.array(*[F.lit(n) for n in self.names[1:]])
        out = self.rows.withColumn("_passed", self._passed())
        return out.filter(F.col("_passed") < len(self.gates)).withColumn("dropped_by", F.get(names, F.col("_passed"))).drop("_passed")

    def funnel(self, pair: Column, source_sec: Column, target_sec: Column) -> DataFrame:
        """Counts, hours and retention per pair and stage."""
        names = F.array(*[F.lit(n) for n in self.names])
        reached = F.slice(names, F.lit(1), self._passed() + 1)
        rows = self.rows.select(pair.alias("pair"), source_sec.alias("src_sec"), target_sec.alias("tgt_sec"), F.posexplode(reached).alias("k", "stage"))
        return stage_statistics(rows, "pair", "stage", "k", "src_sec", "tgt_sec")
