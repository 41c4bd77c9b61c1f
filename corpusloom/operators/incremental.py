"""Resumable work: latest state, pending work, memoised scores, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.selection import latest_per_key
from corpusloom.sources.tsv import exists, files_in
from corpusloom.staging import lookup_join, stage


def latest_progress(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest_per_key(log, keys, order)


def pending(work: DataFrame, log: DataFrame, keys: list[str], order: list[str], status: str = "status", rerun_errors: bool = False, rerun_all: bool = False) -> DataFrame:
    """Work whose latest log row isn't done (nor, unless errors are run again, an error).

    ``rerun_all`` is what running errors again means in language identification: everything.
    """
    if rerun_all:
        return work
    over = ["done"] if rerun_errors else ["done", "error"]
    finished = latest_progress(log, keys, order).filter(F.col(status).isin(*over)).select(*keys)
    return work.join(finished, keys, "left_anti")


def memoised(rows: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None) -> DataFrame:
    """Score each distinct key once, without those in the cache, and join the scores back.

    ``score`` takes a one-column frame and adds columns; ``cache`` has the same columns.
    Null keys have null scores and take no part in the join, which goes by a digest; keys
    that many rows share are spread (``lookup_join``).
    """
    digest = F.unhex(F.md5(F.col(key).cast("string")))
    counted = stage(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")), "distinct")
    wanted = counted.select(key)
    known = wanted.join(cache, key) if cache is not None else None
    fresh = score(wanted.join(cache.select(key), key, "left_anti") if cache is not None else wanted)
    scores = fresh if known is None else fresh.unionByName(known)
    added = [c for c in scores.columns if c != key]
    table = stage(scores.join(counted, key).select(digest.alias("_digest"), *added, F.col("_n")), "scores")
    found = lookup_join(rows.filter(F.col(key).isNotNull()).withColumn("_digest", digest), table, "_digest", weight="_n").select(*rows.columns, *added)
    empty = rows.filter(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in added])
    return found.unionByName(empty)


def coalesced(rows: DataFrame, key: str, lookups: list[DataFrame], value: str) -> DataFrame:
    """``value`` from the first lookup table (key, value) that has it."""
    out, names = rows, []
    for k, lookup in enumerate(lookups):
        names.append(f"_{value}{k}")
        out = out.join(lookup.select(key, F.col(value).alias(names[-1])), key, "left")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def not_cached(rows: DataFrame, key: str, cache: DataFrame, failed: DataFrame) -> DataFrame:
    return rows.join(cache.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def reusable(rows: DataFrame, prior: DataFrame, id_col: str, same: list[str], size_col: str) -> DataFrame:
    """Rows whose prior output exists, isn't empty, and was made from the same columns."""
    right = prior.select(F.col(id_col), *[F.col(c).alias(f"_prior_{c}") for c in same], size_col)
    joined = rows.join(right, id_col)
    for c in same:
        joined = joined.filter(F.col(c).eqNullSafe(F.col(f"_prior_{c}")))
    return joined.filter(F.col(size_col) > 0).drop(*[f"_prior_{c}" for c in same])


def assembled(pairs: DataFrame, sides: dict[str, tuple[str, DataFrame, DataFrame]], extra: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """Rows whose path on every side is in that side's cache and not among its failures.

    ``sides`` gives for each new column the path's column, the cache (path, text) and the
    failures (path); ``extra`` the path's column, a cache and a new column that is empty
    where the cache has nothing. Caches have one row per path.
    """
    out = pairs
    for name, (path, cache, failures) in sides.items():
        ok = cache.toDF("_path", name).join(failures.toDF("_path"), "_path", "left_anti")
        out = lookup_join(out.filter(F.col(path).isNotNull()).withColumn("_path", F.col(path)), stage(ok, "cache"), "_path").drop("_path")
    if extra:
        path, cache, name = extra
        out = out.join(cache.toDF("_path", name), F.col(path) == F.col("_path"), "left").drop("_path").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def isolated(rows: DataFrame, value: str, score: Callable[[list], list], result: str, size: int = 64) -> DataFrame:
    """(columns of ``rows``..., result, status, error): ``score`` applied to lists of values.

    A list whose scoring raises, or gives another number of results or an empty one, is
    scored again value by value; a value that fails alone gets the status ``error`` and
    what was raised, with line breaks escaped, and does no harm to the others.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def one(x):
        try:
            got = score([x])
            if len(got) != 1 or not got[0]:
                raise ValueError("empty result")
            return str(got[0]), "done", None
        except Exception as e:  # noqa: BLE001
            return None, "error", f"{type(e).__name__}: {e}".replace("\r", "\\r").replace("\n", "\\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(value).to_pylist()
            out = []
            for at in range(0, len(values), size):
                part = values[at : at + size]
                try:
                    got = score(part)
                    if len(got) != len(part) or not all(got):
                        raise ValueError("incomplete results")
                    out += [(str(x), "done", None) for x in got]
                except Exception:  # noqa: BLE001
                    out += map(one, part)
            added = [pa.array([x[k] for x in out], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, result, "status", "error"])

    return rows.mapInArrow(run, ", ".join([*fields, f"`{result}` string", "status string", "error string"]))


def contract(spark: SparkSession, path: str, **settings) -> dict[str, str]:
    """What a run depends on: number, size and latest change of its input files, and its settings."""
    seen = files_in(spark, path).agg(F.count("*"), F.sum("length"), F.max("modified").cast("string")).first()
    return {"input_files": str(seen[0]), "input_size": str(seen[1]), "input_modified": str(seen[2])} | {k: str(v) for k, v in settings.items()}


def same_contract(a: dict, b: dict) -> bool:
    """Whether a run may be resumed: every setting is there and equal."""
    return a.keys() == b.keys() and all(a[k] == b[k] for k in a)


def resumed(spark: SparkSession, folder: str, wanted: dict[str, str], work: DataFrame, keys: list[str]) -> DataFrame:
    """The work that a run in ``folder`` has still to do; a run under another contract is an error.

    The first call writes the contract; finished rows are those of the Parquet folder ``done``.
    """
    if exists(spark, f"{folder}/contract"):
        before = {r["key"]: r["value"] for r in spark.read.json(f"{folder}/contract").collect()}
        if not same_contract(before, wanted):
            raise ValueError(f"input or settings have changed since {folder} was begun")
    else:
        spark.createDataFrame(list(wanted.items()), "key string, value string").coalesce(1).write.json(f"{folder}/contract")
    return work.join(spark.read.parquet(f"{folder}/done").select(*keys), keys, "left_anti") if exists(spark, f"{folder}/done") else work


def without_output(work: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Work whose output file isn't there or is empty; ``files`` has ``path`` and ``length``."""
    there = files.filter("length > 0").select(F.regexp_replace("path", "^file:/+", "/").alias(path))
    return work.join(there, path, "left_anti")
