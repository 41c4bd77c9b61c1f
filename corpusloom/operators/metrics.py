"""Metric tables and summaries of an evaluation: registry, precedence, the final table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.relational import join_metrics
from corpusloom.operators.statistics import column_means

#: Summary keys that count as means although their names don't end so.
SUMMARY_MEANS = (
    "dc_0p2_compliance", "dc_0p4_compliance", "sc_0p2_compliance", "sc_0p4_compliance",
    "speech_rate_syllable_spearman", "pause_joint_score", "pause_wmean_duration_score",
)


@dataclass
class Registry:
    """Named metrics, each a function from the manifest to a table keyed by the id."""

    metrics: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def add(self, name: str) -> Callable:
        def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            self.metrics[name] = f
            return f

        return register

    def per_example(self, manifest: DataFrame, enabled: list[str], id_col: str = "sample_id") -> DataFrame:
        """All enabled metrics left-joined onto the distinct ids."""
        unknown = [n for n in enabled if n not in self.metrics]
        if unknown:
            raise ValueError(f"Unknown metrics: {unknown}")
        return join_metrics(manifest.select(id_col).distinct(), {n: self.metrics[n](manifest) for n in enabled}, id_col)


def summary_means(summaries: list[dict]) -> dict[str, float]:
    """``<key>_mean`` of each summary in turn; later ones overwrite earlier ones."""
    out = {}
    for data in summaries:
        for key, value in data.items():
            if key.endswith("_mean"):
                out[key] = value
            elif key in SUMMARY_MEANS:
                out[f"{key}_mean"] = value
    return out


def aggregate(per_example: DataFrame, summaries: list[dict], id_col: str = "sample_id", uncertainty: str = "none") -> DataFrame:
    """(key, value, pm): means of every numeric column, except where a summary has the key."""
    given = summary_means(summaries)
    spark = per_example.sparkSession
    measured = column_means(per_example, id_col, uncertainty).select(F.concat("metric", F.lit("_mean")).alias("key"), F.col("mean").alias("value"), "pm")
    fixed = spark.createDataFrame([(k, None if v is None else float(v), None) for k, v in given.items()], "key string, value double, pm double")
    return measured.filter(~F.col("key").isin(list(given)) if given else F.lit(True)).unionByName(fixed)


def table(aggregated: DataFrame, rows: list[tuple[str, list[str]]], digits: int = 4) -> DataFrame:
    """(name, value, pm) in the given order: for each name the first of its keys that has a value."""
    spark = aggregated.sparkSession
    wanted = spark.createDataFrame([(at, name, k, key) for at, (name, keys) in enumerate(rows) for k, key in enumerate(keys)], "at int, name string, k int, key string")
    best = F.min(F.when(F.col("value").isNotNull(), F.struct("k", "value", "pm"))).alias("b")
    found = F.broadcast(wanted).join(aggregated, "key", "left").groupBy("at", "name").agg(best)
    return found.select("at", "name", F.round("b.value", digits).alias("value"), F.round("b.pm", digits).alias("pm"))
