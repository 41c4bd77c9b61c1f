"""Tables written once and read several times, and checks of sizes before a broadcast.

A staged table cuts the lineage: a lost executor costs the tasks it was running, not the
stages before. Staged tables lie in the folder that ``spark.checkpoint.dir`` names, which
all executors of a cluster share.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_folder


_staged: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it.

    The table stays until ``release`` is called, at the latest when the driver's process ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet, to be removed by ``release``."""
    root = shared_folder(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not _staged:
        atexit.register(lambda: release(spark))
    _staged.append(f"{root.rstrip('/')}/corpusloom-{name}-{uuid.uuid4().hex}")
    return _staged[-1]


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder with all it holds; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def release(spark: SparkSession) -> int:
    """Remove all tables staged by this process; results that read them must be done. Returns their number."""
    done = 0
    while _staged:
        path = _staged.pop()
        try:
            done += remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            break
    return done


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str | None = None, max_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Inner join with a table of one row per key, where a key may hold a third of ``rows``.

    Up to ``max_rows`` rows of ``lookup`` are broadcast, after they were counted. Beyond
    that, with ``weight`` (the number of ``rows`` of each key), the ``max_rows`` heaviest
    keys are broadcast and the rest joined by shuffle: of those none holds more than one
    row in ``max_rows``. Without ``weight`` each lookup row is repeated once per salt and
    the rows are spread over the salts.
    """
    if fits(lookup, max_rows):
        return rows.join(F.broadcast(lookup), key)
    if weight:
        heavy = stage(lookup.orderBy(F.desc(weight), key).limit(max_rows), "heavy")
        light = lookup.join(F.broadcast(heavy.select(key)), key, "left_anti")
        rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
        return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread: Column = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", spread).join(salted, [key, "_salt"]).drop("_salt")


def grid_join(left: DataFrame, right: DataFrame, key: str, max_rows: int = 20_000, max_keys: int = 50_000, unique: bool = False) -> DataFrame:
    """Inner join on ``key``, of which either side may hold a third of its rows.

    A key with more than ``max_rows`` rows on a side is cut there into parts of about that
    size, and the other side's rows go to each of them, so a task gets a cell of the grid
    of both sides' parts. The ``max_keys`` heaviest such keys are broadcast with their
    numbers of parts; of the others none holds more than one row in ``max_keys``.
    ``unique`` says that ``right`` has one row per key and needn't be counted.
    """

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_rows).select(key, F.ceil(F.col("_n") / max_rows).cast("int").alias(name))

    # A side of no more than max_rows rows has no such key, and isn't counted.
    crowded = [(df, name) for df, name in ((left, "_l"), (right, "_r")) if not (unique and df is right) and not fits(df, max_rows)]
    if not crowded:
        return left.join(right, key)
    counted = [parts(df, name) for df, name in crowded]
    both = counted[0].join(counted[1], key, "full") if len(counted) == 2 else counted[0].withColumn("_r" if crowded[0][1] == "_l" else "_l", F.lit(1))
    heavy = both.select(key, F.coalesce("_l", F.lit(1)).alias("_l"), F.coalesce("_r", F.lit(1)).alias("_r"))
    heavy = stage(heavy.orderBy(F.desc(F.greatest("_l", "_r")), key).limit(max_keys), "grid")
    if fits(heavy, 0):
        return left.join(right, key)

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce(F.col(own), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return df.join(F.broadcast(heavy), key, "left").withColumn(f"_at{own}", spread).withColumn(f"_at{other}", every).drop("_l", "_r")

    return placed(left, "_l", "_r").join(placed(right, "_r", "_l"), [key, "_at_l", "_at_r"]).drop("_at_l", "_at_r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
