"""Quality selection, deterministic samples, exact-size splits, shards and batches.

Pseudo-random order is the md5 of ``seed:id``, equal on every engine and cluster. Exact
sizes come from a distributed rank: rows are never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.expr import no_nan
from corpusloom.operators.relational import with_position
from corpusloom.staging import stage


#: Rows up to which the best are found without sorting all.
TOP = 100_000


def shuffle_key(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def decisions(rows: DataFrame, keep: Column, reason: str) -> DataFrame:
    """``selected`` and ``drop_reason`` columns; the reason is empty for kept rows."""
    kept = F.coalesce(keep, F.lit(False))
    return rows.withColumn("selected", kept).withColumn("drop_reason", F.when(kept, "").otherwise(reason))


def by_cutoff(rows: DataFrame, score: str, cutoff: float) -> DataFrame:
    return decisions(rows, no_nan(F.col(score)) >= cutoff, "below_cutoff")


def top_n(rows: DataFrame, score: str, n: int, id_col: str) -> DataFrame:
    """Decisions for the n best scores, ties in shuffle order; missing and NaN scores come last.

    Fails if there are fewer rows than n. Up to ``TOP`` rows are found by a top-k of each
    partition, and only the last of them is compared with the others; for more, positions
    in the whole order are computed.
    """
    if n > rows.count():
        raise ValueError(f"{n} rows wanted, more than there are")
    s = no_nan(F.col(score))
    order = F.struct(s.isNull().alias("none"), (-s).alias("minus"), F.md5(F.col(id_col).cast("string")).alias("key"), F.col(id_col).alias("id"))
    if n > TOP:
        placed = with_position(rows.withColumn("_order", order), ["_order"])
        return decisions(placed, F.col("position") < n, "below_top_n_boundary").drop("_order", "position")
    last = rows.select(order.alias("_order")).orderBy("_order").limit(n).agg(F.max("_order").alias("o")).first()[0] if n > 0 else None
    if last is None:
        return decisions(rows, F.lit(False), "below_top_n_boundary")
    kinds = dict(rows.select(order.alias("o")).select("o.*").dtypes)
    boundary = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in ("none", "minus", "key", "id")])
    return decisions(rows, order <= boundary, "below_top_n_boundary")


def retained_boundary(decided: DataFrame, score: str) -> DataFrame:
    """Lowest retained score with the counts of both sides."""
    return decided.agg(F.min(F.when(F.col("selected"), F.col(score))).alias("boundary"), F.count_if("selected").alias("kept"), F.count_if(~F.col("selected")).alias("dropped"))


def sample_exact(rows: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, round(n * fraction)) rows in shuffle order; a fraction of 1 is everything."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    if fraction == 1:
        return rows
    n = max(1, round(rows.count() * fraction))
    return with_position(rows.withColumn("_key", shuffle_key(F.col(id_col), seed)), ["_key", id_col]).filter(F.col("position") < n).drop("_key", "position")


def assign_splits(rows: DataFrame, id_col: str, ratio: float, test_size: int, seed: int = 42) -> DataFrame:
    """``split`` column with exactly ``test_size`` test rows and round(n * ratio) held out."""
    n = rows.count()
    held = round(n * ratio)
    if test_size <= 0:
        raise ValueError("test_size must be positive")
    if held <= test_size:
        raise ValueError(f"dev and test rows ({held}) must be more than test rows ({test_size})")
    placed = with_position(rows.withColumn("_key", shuffle_key(F.col(id_col), seed)), ["_key", id_col])
    at = F.col("position")
    return placed.withColumn("split", F.when(at < test_size, "test").when(at < held, "dev").otherwise("train")).drop("_key", "position")


def existing_split(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isin("train", "dev", "test"))


def shards(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Round-robin ``shard`` by position in the order."""
    return with_position(rows, order).withColumn("shard", F.pmod("position", F.lit(n)).cast("int")).drop("position")


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Consecutive ``batch`` numbers of ``size`` rows."""
    return with_position(rows, order).withColumn("batch", F.floor(F.col("position") / size)).drop("position")


def halves(rows: DataFrame, order: list[str]) -> DataFrame:
    middle = max(1, rows.count() // 2)
    return with_position(rows, order).withColumn("half", F.when(F.col("position") < middle, 0).otherwise(1)).drop("position")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order: an aggregate with map-side combining, no sort."""
    return _one_per_key(rows, keys, order, F.min)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order."""
    return _one_per_key(rows, keys, order, F.max)


def _one_per_key(rows: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    value = F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))
    return rows.groupBy(*keys).agg(pick(value).alias("_v")).select(*keys, "_v.r.*").select(*rows.columns)


def mixed_order(id_: Column) -> list[Column]:
    """Whole numbers first by value, then other ids by their text."""
    number = F.when(id_.rlike(r"^\s*[-+]?\d{1,18}\s*$"), id_.try_cast("bigint"))
    return [number.asc_nulls_last(), id_.asc()]


def beam_score(log_prob: Column, length: Column, alpha: float, capped: Column | None = None, cap_penalty: float = 0.0) -> Column:
    """Log probability over length to the power of ``alpha``, less a penalty where the length was capped."""
    score = log_prob / F.pow(F.greatest(length, F.lit(1)).cast("double"), F.lit(alpha)) if alpha > 0 else log_prob
    return score if capped is None else score - F.when(capped, F.lit(cap_penalty)).otherwise(0.0)


def running_counts(rows: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """(groups..., value, _n, _upto) of each distinct value: its rows, and those of the group up to it.

    Values are counted first. The counts are range-partitioned and summed within their
    partition; one sum per partition and group gives what lies before. So no group is
    gathered in one task.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    placed = stage(counted.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()), "ordered")
    within = placed.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_part", *groups).orderBy(value)))
    sizes = placed.groupBy("_part", *groups).agg(F.sum("_n").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_size")).drop("_size")
    right = before.withColumnsRenamed({c: f"_r{c}" for c in ("_part", *groups)})
    joined = within.join(right, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in ("_part", *groups)])
    return joined.withColumn("_upto", F.col("_upto") + F.col("_before")).select(*groups, value, "_n", "_upto")


def ranks_with_ties(rows: DataFrame, value: str, groups: list[str], name: str) -> DataFrame:
    """(groups..., value, _n, name): the average rank of each distinct value within its group."""
    return running_counts(rows, value, groups).withColumn(name, F.col("_upto") - (F.col("_n") - 1) / 2.0).drop("_upto")


def quantiles(rows: DataFrame, value: str, groups: list[str], wanted: dict[str, float]) -> DataFrame:
    """(groups..., one column per wanted quantile), interpolated between the two nearest values."""
    counts = running_counts(rows, value, groups)
    total = F.max("_upto").over(Window.partitionBy(*groups))
    totals = counts.groupBy(*groups).agg(F.max("_upto").alias("_total")).withColumnsRenamed({c: f"_r{c}" for c in groups})
    joined = counts.join(totals, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in groups]) if groups else counts.withColumn("_total", total)
    aggs = []
    for name, q in wanted.items():
        place = (F.col("_total") - 1) * q
        at = lambda k: F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_n") <= k), F.col(value)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        aggs.append((low + (high - low) * part).alias(name))
    return joined.groupBy(*groups).agg(*aggs)
