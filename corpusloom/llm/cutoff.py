"""Score cutoffs that keep a target fraction of each source's records.

Distinct scores are counted per source and those compact counts summed from the top; the
cutoff is the highest score at which the kept fraction reaches the target. Sums go over
``BINS`` bins of the score range first and then over the distinct scores of the one bin
per source in which the target is reached. A bin with more than ``MOST`` distinct scores
is divided into bins again, so no source is gathered in one task however many distinct
scores it has.

A record is a distinct id; of several valid scores of one id the highest counts. Null,
NaN and out-of-range scores are no records. A source without target, or with a null
target, has no cutoff and keeps nothing; a target of 0 or less keeps the top score.
Ties at the cutoff are all kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.staging import fits, lookup_join, stage

BINS = 16_384
MOST = 100_000


def scored_records(scores: DataFrame, id_col: str, score_col: str, low: float, high: float, source_chars: int = 5) -> DataFrame:
    """(source, id, score) of the distinct records."""
    s = F.col(score_col)
    return (
        scores.filter(F.col(id_col).isNotNull() & s.between(low, high) & ~F.isnan(s))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(s).alias("score"))
        .select(F.substring("id", 1, source_chars).alias("source"), "id", "score")
    )


def cutoffs(records: DataFrame, targets: DataFrame, low: float, high: float, bins: int = BINS, most: int = MOST) -> DataFrame:
    """(source, target, records, cutoff, kept) from (source, id, score) and (source, target)."""
    counts = stage(records.groupBy("source", "score").count(), "counts")
    goal = targets.filter("target is not null").groupBy("source").agg(F.max("target").alias("target"))
    total = counts.groupBy("source").agg(F.sum("count").alias("records"))
    # The scores among which a source's cutoff lies, and the number of records above them.
    span = total.join(goal, "source").select("*", F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(0).cast("bigint").alias("above"))
    while True:
        span = stage(span, "span")
        inside = lookup_join(counts, span, "source").filter(F.col("score").between(F.col("low"), F.col("high")))
        place = F.floor(F.try_divide(F.col("score") - F.col("low"), F.col("high") - F.col("low")) * bins)
        within = inside.withColumn("bin", F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)))
        by_bin = within.groupBy("source", "target", "records", "above", "bin").agg(F.sum("count").alias("n"), F.count("*").alias("scores"), F.min("score").alias("low"), F.max("score").alias("high"))
        upto = F.col("above") + F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("bin")))
        crossing = (
            by_bin.withColumn("upto", upto)
            .filter(F.col("upto") / F.col("records") >= F.col("target"))
            .groupBy("source", "target", "records")
            .agg(F.max(F.struct("bin", "low", "high", "scores", (F.col("upto") - F.col("n")).alias("above"))).alias("c"))
        )
        crossing = stage(crossing.select("source", "target", "records", "c.low", "c.high", "c.above", "c.scores"), "crossing")
        span = crossing.drop("scores")
        if fits(crossing.filter(F.col("scores") > most), 0):
            break
    last = lookup_join(counts, span, "source").filter(F.col("score").between(F.col("low"), F.col("high")))
    kept = F.col("above") + F.sum("count").over(Window.partitionBy("source").orderBy(F.desc("score")))
    found = last.withColumn("kept", kept).filter(F.col("kept") / F.col("records") >= F.col("target"))
    return stage(found.groupBy("source", "target", "records").agg(F.max("score").alias("cutoff"), F.min("kept").alias("kept")), "cuts")


def kept_records(records: DataFrame, cuts: DataFrame) -> DataFrame:
    """(source, id, score) of the records at or above their source's cutoff."""
    return lookup_join(records, cuts.select("source", "cutoff"), "source").filter("score >= cutoff").select("source", "id", "score")


def pair_spelling(name: Column) -> Column:
    """``EN-ES``, `` en_es`` and the like as ``en_es``."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[^a-z]+", "_")
