"""Distributions, confidence intervals, correlations, errors and stage funnels.

The four interval conventions that evaluation code mixes are kept apart by name:
``t_interval`` (no width for one value or none of spread), ``t_interval_bare`` (no guard),
``t_margin`` (null for one value) and ``normal_margin`` (1.96 standard errors).
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from corpusloom.functions.expr import abs_log_ratio, no_nan, to_number
from corpusloom.operators.selection import quantiles, ranks_with_ties
from corpusloom.staging import lookup_join, stage

QUANTILES = {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}
#: Degrees of freedom with a row of their own; beyond, an expansion around the normal quantile is used.
T_TABLE = 200


# Student's t ----------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@lru_cache
def t_quantile(df: int, p: float = 0.975) -> float:
    """The p-quantile of Student's t, by bisection on its distribution function."""
    low, high = 0.0, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        upper = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + mid * mid))
        low, high = (mid, high) if 1 - upper < p else (low, mid)
    return (low + high) / 2


def t_factor(n: Column) -> Column:
    """t quantile for n values, as an expression: a short table, then a series in 1/df."""
    df = n - 1
    z = 1.959963984540054
    series = z + (z**3 + z) / (4.0 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96.0 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384.0 * df**3)
    table = F.array(*[F.lit(t_quantile(k)) for k in range(1, T_TABLE + 1)])
    return F.when(df <= T_TABLE, F.get(table, df.cast("int") - 1)).otherwise(series)


# Distributions --------------------------------------------------------------------------


def sem(x: Column) -> Column:
    """Standard error; 0 for a single value."""
    n = F.count(x)
    return F.when(n > 1, F.stddev_samp(x) / F.sqrt(n)).when(n == 1, F.lit(0.0))


def distribution(rows: DataFrame, value: str, prefix: str, groups: Iterable[str] = ()) -> DataFrame:
    """n, mean, median, spread, t interval, extremes and quantiles of the numbers in a column.

    Missing values and NaN take no part; a group without any has no row.
    """
    x = no_nan(F.col("_x"))
    numbers = rows.select(*groups, to_number(F.col(value)).alias("_x"))
    groups = list(groups)
    numbers = numbers.filter(x.isNotNull())
    cuts = quantiles(numbers, "_x", groups, {f"{prefix}_median": 0.5} | {f"{prefix}_{k}": q for k, q in QUANTILES.items()})
    right = cuts.withColumnsRenamed({c: f"_r{c}" for c in groups})
    out = (
        numbers.groupBy(*groups)
        .agg(
            F.count("_x").alias(f"{prefix}_n"),
            F.avg("_x").alias(f"{prefix}_mean"),
            F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias(f"{prefix}_std"),
            sem(F.col("_x")).alias(f"{prefix}_sem"),
            F.min("_x").alias(f"{prefix}_min"),
            F.max("_x").alias(f"{prefix}_max"),
        )
    )
    out = out.join(right, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in groups] or F.lit(True), "left").drop(*(f"_r{c}" for c in groups))
    return t_interval(out.filter(F.col(f"{prefix}_n") > 0), prefix)


def t_interval(summary: DataFrame, prefix: str) -> DataFrame:
    """95 % interval from ``<prefix>_n/_mean/_sem``, without width where the error is 0."""
    half = F.when(F.col(f"{prefix}_n") > 1, F.col(f"{prefix}_sem") * t_factor(F.col(f"{prefix}_n"))).otherwise(0.0)
    mean = F.col(f"{prefix}_mean")
    return summary.withColumn(f"{prefix}_ci95_half_width", half).withColumn(f"{prefix}_ci95_low", mean - half).withColumn(f"{prefix}_ci95_high", mean + half)


def t_margin(n: Column, error: Column) -> Column:
    return F.when(n > 1, error * t_factor(n))


def t_interval_bare(mean: Column, n: Column, error: Column) -> Column:
    """(low, high); a single value has no width, an error of 0 gives NaN as the bare formula does."""
    half = F.when(n <= 1, F.lit(0.0)).when(error == 0, F.lit(float("nan"))).otherwise(error * t_factor(n))
    return F.struct((mean - half).alias("low"), (mean + half).alias("high"))


def normal_margin(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 1, 1.96 * F.stddev_samp(x) / F.sqrt(n))


def share_at_least(x: Column, limit: float) -> Column:
    return F.avg(F.when(x >= limit, 1.0).when(x < limit, 0.0))


def weighted_mean(x: Column, w: Column) -> Column:
    used = x.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(used, x * w)), F.sum(F.when(used, w)))


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two pairs or a side without spread."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.when(F.count_if(both) > 1, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def spearman(rows: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """Pearson of average ranks per group, over pairs with both values.

    Ranks are looked up by value; values that many rows share are spread (``lookup_join``).
    """
    key = lambda c: F.struct(*groups, c)
    pairs = rows.select(*groups, to_number(F.col(x)).alias("_x"), to_number(F.col(y)).alias("_y")).filter("_x is not null and _y is not null")
    ranked = stage(pairs.select("*", key("_x").alias("_kx"), key("_y").alias("_ky")), "pairs")
    for c in ("x", "y"):
        table = stage(ranks_with_ties(ranked, f"_{c}", groups, f"_r{c}").select(key(f"_{c}").alias(f"_k{c}"), f"_r{c}", F.col("_n").alias(f"_n{c}")), "ranks")
        ranked = lookup_join(ranked, table, f"_k{c}", weight=f"_n{c}")
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), pearson(F.col("_x"), F.col("_y")).alias("pearson"), pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def correlation_table(rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(unit, n, pearson, spearman) of several column pairs; a unit with fewer than two pairs of numbers has no row."""
    parts = F.array(*[F.struct(F.lit(unit).alias("unit"), to_number(F.col(a)).alias("x"), to_number(F.col(b)).alias("y")) for unit, (a, b) in columns.items()])
    return spearman(rows.select(F.inline(parts)), "x", "y", ["unit"]).filter("n > 1")


def filter_counts(source: DataFrame, target: DataFrame, key: str, valid: str) -> DataFrame:
    """One row: of both sides the raw, matched, invalid and unmatched rows, and the keys kept and dropped.

    A key is kept if some row of each side with that key is valid. Rows are counted per key
    first, so the outer join has one row per key and side.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        ok = F.coalesce(F.col(valid), F.lit(False))
        return df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(f"{name}_rows"), F.count_if(ok).alias(f"{name}_valid"))

    both = side(source, "src").join(side(target, "tgt"), "k", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    matched = F.col("src_rows").isNotNull() & F.col("tgt_rows").isNotNull()
    out = both.agg(
        *[F.coalesce(F.sum(n(f"{s}_rows")), F.lit(0)).alias(f"{s}_raw") for s in ("src", "tgt")],
        *[F.coalesce(F.sum(F.when(matched, F.col(f"{s}_rows"))), F.lit(0)).alias(f"{s}_matched") for s in ("src", "tgt")],
        F.count_if(matched & (F.col("src_valid") > 0) & (F.col("tgt_valid") > 0)).alias("kept"),
        *[F.coalesce(F.sum(n(f"{s}_rows") - n(f"{s}_valid")), F.lit(0)).alias(f"{s}_invalid") for s in ("src", "tgt")],
    )
    return out.select("*", (F.greatest("src_matched", "tgt_matched") - F.col("kept")).alias("dropped"), *[(F.col(f"{s}_raw") - F.col(f"{s}_matched")).alias(f"{s}_unmatched") for s in ("src", "tgt")])


def summed(shards: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of all shards added up, column by column."""
    return shards.agg(*[F.sum(c).alias(c) for c in shards.columns if c not in without])


def errors(x: Column, y: Column) -> list[Column]:
    """Error measures of y against x."""
    d = y - x
    ratio = abs_log_ratio(x, y)
    return [
        F.count(d).alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(d).alias("mean_signed_diff"),
        F.avg(ratio).alias("mean_abs_log_ratio"),
    ]


def column_means(rows: DataFrame, id_col: str, uncertainty: str = "none") -> DataFrame:
    """(metric, n, mean, pm) for every column that holds numbers, as numbers or as text; one pass over the rows."""
    values = {f.name: no_nan(F.col(f.name).cast("double")) if isinstance(f.dataType, NumericType) else to_number(F.col(f.name)) for f in rows.schema if f.name != id_col and isinstance(f.dataType, (NumericType, StringType))}
    numbers = rows.select(*[x.alias(f"_{k}") for k, x in enumerate(values.values())])

    def pm(x: Column) -> Column:
        return {"none": F.lit(None).cast("double"), "std": F.stddev_samp(x), "sem": F.when(F.count(x) > 1, F.stddev_samp(x) / F.sqrt(F.count(x))), "ci95": normal_margin(x)}[uncertainty]

    aggs = [a for k in range(len(values)) for x in [F.col(f"_{k}")] for a in (F.count(x).alias(f"n{k}"), F.avg(x).alias(f"mean{k}"), pm(x).alias(f"pm{k}"))]
    if not aggs:
        return rows.sparkSession.createDataFrame([], "metric string, n bigint, mean double, pm double")
    parts = [F.struct(F.lit(c).alias("metric"), F.col(f"n{k}").alias("n"), F.col(f"mean{k}").alias("mean"), F.col(f"pm{k}").alias("pm")) for k, c in enumerate(values)]
    return numbers.agg(*aggs).select(F.inline(F.array(*parts))).filter("n > 0")


def masked_pooling(rows: DataFrame, keys: list[str], position: str, value: str, mask: str | None = None, floor: float = 1e-12, shift: float = 0.0) -> DataFrame:
    """Mean and deviation per dimension over frames; the variance is floored, then shifted."""
    used = F.col(mask) if mask else F.lit(True)
    x = F.when(used, F.col(value).cast("double"))
    return rows.groupBy(*keys, position).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.sqrt(F.greatest(F.coalesce(F.var_pop(x), F.lit(0.0)), F.lit(floor)) + shift).alias("std"))


def segment_means(values: Column, k: int) -> Column:
    """Means of k equal parts of an array; with fewer elements a part is one of them."""
    n = F.size(values)

    def part(i: Column) -> Column:
        a, b = F.floor(i * n / k).cast("int"), F.floor((i + 1) * n / k).cast("int")
        length = F.greatest(b - a, F.lit(1))
        return F.aggregate(F.slice(values, F.least(a, n - 1) + 1, length), F.lit(0.0), lambda s, x: s + x) / length

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), part))


# Funnel ---------------------------------------------------------------------------------


def stage_statistics(rows: DataFrame, pair: str, stage: str, order: str, source_sec: str, target_sec: str, first_stages: tuple[str, ...] = ()) -> DataFrame:
    """One row per pair and stage: counts, hours, averages and retention from the stage before."""
    src, tgt = F.coalesce(F.sum(to_number(F.col(source_sec))), F.lit(0.0)), F.coalesce(F.sum(to_number(F.col(target_sec))), F.lit(0.0))
    n = F.count("*")
    out = rows.groupBy(pair, stage, order).agg(
        n.alias("num_pairs"),
        (src / 3600).alias("source_hours"),
        (tgt / 3600).alias("target_hours"),
        ((src + tgt) / 3600).alias("total_hours"),
        (src / n).alias("avg_source_duration_sec"),
        (tgt / n).alias("avg_target_duration_sec"),
    )
    return with_retention(out, pair, order, stage, first_stages)


def with_retention(stats: DataFrame, pair: str, order: str, stage: str, without: tuple[str, ...] = ()) -> DataFrame:
    before = F.lag("num_pairs").over(Window.partitionBy(pair).orderBy(order))
    retention = F.when(before > 0, F.col("num_pairs") / before)
    return stats.withColumn("retention_from_previous_stage", F.when(~F.col(stage).isin(*without), retention) if without else retention)


def mismatches(got: DataFrame, expected: DataFrame, keys: list[str], hours: list[str], tolerance: float = 0.02) -> DataFrame:
    """Rows whose count differs, or whose hours differ by more than the tolerance."""
    right = expected.withColumnsRenamed({c: f"expected_{c}" for c in expected.columns if c not in keys})
    far = [F.abs(F.col(c) - F.col(f"expected_{c}")) > tolerance for c in hours]
    bad = F.col("num_pairs") != F.col("expected_num_pairs")
    for f in far:
        bad = bad | f
    return got.join(right, keys).filter(bad)
