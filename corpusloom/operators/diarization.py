"""Speaker aggregates of segment lists, as logged (shared time counts more than once).

For continuous periods, where each moment counts once, see ``intervals``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.intervals import listed_segments

_LIST = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("speaker", pa.string())]))


def segment_lists(logs: DataFrame, keys: list[str], json_col: str = "segments_json") -> DataFrame:
    """(keys..., segments): each list, in any notation and unmerged; null where it isn't valid JSON."""
    schema = ", ".join([*(f"`{c}` {logs.schema[c].dataType.simpleString()}" for c in keys), "segments array<struct<start:double,end:double,speaker:string>>"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [listed_segments(t) for t in batch.column(len(keys)).to_pylist()]
            lists = pa.array([x and [dict(zip(("start", "end", "speaker"), s)) for s in x] for x in read], _LIST)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), lists], [*keys, "segments"])

    return logs.select(*keys, json_col).mapInArrow(parse, schema)


def speaker_seconds(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys, "speaker").agg(
        F.sum(F.col("end") - F.col("start")).alias("seconds"),
        F.count("*").alias("segments"),
        F.min(F.struct("start", "end")).alias("first"),
    )


def analysis(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Speakers, switches and the dominant speaker (the earliest of equal ones) of each list."""
    per = speaker_seconds(segments, keys)
    # Least of (-seconds, first segment, speaker): aggregates combine before the shuffle.
    best = F.min(F.struct((-F.col("seconds")).alias("minus"), "first", "speaker"))
    total = per.groupBy(*keys).agg(F.count("*").alias("num_speakers"), F.sum("segments").alias("num_segments"), F.sum("seconds").alias("total_labeled_duration"), best.alias("_best"))
    joined = total.join(switches(segments, keys), keys)
    dominant = -F.col("_best.minus")
    return joined.select(
        *keys,
        "num_speakers",
        "num_segments",
        "speaker_switches",
        "total_labeled_duration",
        F.col("_best.speaker").alias("dominant_speaker"),
        dominant.alias("dominant_duration"),
        (F.col("total_labeled_duration") - dominant).alias("secondary_duration"),
        F.coalesce(F.try_divide(F.col("total_labeled_duration") - dominant, F.col("total_labeled_duration")), F.lit(0.0)).alias("secondary_ratio"),
    )


def switches(segments: DataFrame, keys: list[str]) -> DataFrame:
    before = F.lag("speaker").over(Window.partitionBy(*keys).orderBy("start", "end", "speaker"))
    return segments.select(*keys, (before != F.col("speaker")).alias("_switch")).groupBy(*keys).agg(F.count_if("_switch").alias("speaker_switches"))
