"""Structured Streaming forms of the progress log: an extension, the same results as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.incremental import latest_progress
from corpusloom.staging import remove, stage


def stream_parquet(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a growing folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_state(stream: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Running latest row per key; state is one row per key."""
    newest = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*value).alias("v"))).alias("_n")
    return stream.groupBy(*keys).agg(newest).select(*keys, "_n.v.*")


def status_windows(stream: DataFrame, time_col: str, status: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts per status and time window; late rows within the delay still count."""
    at = F.col(time_col).cast("timestamp")
    return (
        stream.withColumn(time_col, at)
        .withWatermark(time_col, delay)
        .groupBy(F.window(time_col, width).alias("w"), status)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), status, "n")
    )


def _children(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[int]]:
    """The batches that have written each bucket, in order."""
    found: dict[int, list[int]] = {}
    for name in _children(spark, path):
        kind, _, number = name.partition("=")
        if kind == "version" and (below is None or int(number) < below):
            for inner in _children(spark, f"{path}/{name}"):
                if inner.startswith("bucket="):
                    found.setdefault(int(inner[7:]), []).append(int(number))
    return {b: sorted(v) for b, v in found.items()}


def _read(spark: SparkSession, path: str, newest: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/version={v}/bucket={b}" for b, v in sorted(newest.items())]
    return spark.read.option("basePath", path).parquet(*folders).drop("version") if folders else None


def current_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that ``upsert_latest`` keeps: of each bucket its newest version."""
    state = _read(spark, path, {b: v[-1] for b, v in _versions(spark, path).items()})
    return state.drop("bucket") if state is not None else None


def upsert_latest(path: str, keys: list[str], order: list[str], buckets: int = 64):
    """A ``foreachBatch`` function that keeps a folder of latest rows, in buckets of the keys' hash.

    A batch rewrites only the buckets that it touches, under its own number, so one that is
    run again after a failure finds the same state below it and writes the same rows. Of
    each bucket the version before is kept for that; older ones are removed.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        news = stage(latest_progress(batch, keys, order).select("*", bucket), "news")
        touched = [r[0] for r in news.select("bucket").distinct().collect()]
        versions = {b: v for b, v in _versions(spark, path, number).items() if b in touched}
        state = _read(spark, path, {b: v[-1] for b, v in versions.items()})
        merged = news if state is None else state.unionByName(news)
        kept = latest_progress(merged.drop("bucket"), keys, order).select("*", bucket)
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        for b, found in versions.items():
            for old in found[:-1]:
                remove(spark, f"{path}/version={old}/bucket={b}")

    return run
