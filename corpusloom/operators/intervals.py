"""Merging overlapping time intervals into periods, and listing the gaps between them.

Starts and ends of an entity's intervals are sorted apart from each other. With ranks
from 1, a gap lies between rank i and i + 1 exactly where the start of rank i + 1 exceeds
the end of rank i: then all of the first i intervals are over before any other begins.
The starts after gaps and the ends before gaps, paired by rank, are the periods.

No entity is ever gathered in one task. Its time line is cut into buckets of
``bucket_ms``; of intervals with the same start only the longest is kept, so a bucket
holds ``bucket_ms`` starts at most. What buckets need from each other (the latest end so
far, the end of the period that runs on) goes through one summary row per bucket.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.staging import stage

#: The field names under which segment objects carry their three values.
START_NAMES = ("start", "begin", "start_time")
END_NAMES = ("end", "end_time")
SPEAKER_NAMES = ("speaker", "speaker_id", "label")

BUCKET_MS = 120_000


def _number(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        raise ValueError
    value = float(x)
    if not math.isfinite(value):
        raise ValueError
    return value


def _one(x: Any) -> tuple[float, float, str] | None:
    """A segment in any single notation, or None where it can't be read."""
    if isinstance(x, dict):
        triple = [next((x[n] for n in names if x.get(n) is not None), None) for names in (START_NAMES, END_NAMES, SPEAKER_NAMES)]
    elif isinstance(x, list):
        triple = x[:3]
    elif isinstance(x, str):
        triple = x.replace(",", " ").split()[:3]
    else:
        return None
    if len(triple) < 3 or any(v is None for v in triple) or isinstance(triple[2], (list, dict)):
        return None
    try:
        return _number(triple[0]), _number(triple[1]), str(triple[2])
    except ValueError:
        return None


def listed_segments(text: str | None) -> list[tuple[float, float, str]] | None:
    """All readable segments of a JSON text as (start, end, speaker), as listed, in seconds.

    Objects under several field names, triples, plain text, numbers as text, lists within
    lists and any mixture are read; an element that can't be read is passed over, and so
    is a segment whose end isn't after its start. Null has no segments; of invalid JSON
    nothing is known, which None tells.
    """
    if text is None:
        return []
    try:
        open_ = [json.loads(text)]
    except (ValueError, RecursionError):
        return None
    found = []
    while open_:
        x = open_.pop()
        got = _one(x)
        if got:
            if got[1] > got[0]:
                found.append(got)
        elif isinstance(x, list):
            open_ += x
    return found


def read_segments(text: str | None) -> list[tuple[int, int, str]]:
    """The listed segments as (start_ms, end_ms, speaker), without those that are empty in whole milliseconds."""
    rounded = ((round(s * 1000), round(e * 1000), speaker) for s, e, speaker in listed_segments(text) or [])
    return [x for x in rounded if x[1] > x[0]]


def paired(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Periods of the intervals with these starts and ends, by independent ranks."""
    starts, ends = sorted(starts), sorted(ends)
    breaks = [i for i in range(1, len(starts)) if starts[i] > ends[i - 1]]
    return [(starts[a], ends[b - 1]) for a, b in zip([0, *breaks], [*breaks, len(starts)])]


def segments(logs: DataFrame, json_col: str, entity: list[str]) -> DataFrame:
    """(entity..., speaker, start_ms, end_ms), merged within each row before any shuffle."""
    fields = [logs.schema[c] for c in entity]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "speaker string, start_ms bigint, end_ms bigint"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, who, start, end = [], [], [], []
            for i, text in enumerate(batch.column(len(entity)).to_pylist()):
                by: dict[str, tuple[list[int], list[int]]] = {}
                for s, e, speaker in read_segments(text):
                    lists = by.setdefault(speaker, ([], []))
                    lists[0].append(s)
                    lists[1].append(e)
                for speaker, (ss, ee) in by.items():
                    for s, e in paired(ss, ee):
                        at.append(i)
                        who.append(speaker)
                        start.append(s)
                        end.append(e)
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(entity))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(who, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], [*entity, "speaker", "start_ms", "end_ms"])

    return logs.select(*entity, json_col).mapInArrow(parse, schema)


def periods_and_gaps(intervals: DataFrame, entity: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(entity..., kind, start_ms, end_ms): ``kind`` is ``period`` or ``gap``.

    ``intervals`` has the entity's columns, ``start_ms`` and ``end_ms``. Intervals that
    touch belong together; rows with a null or an end not after the start take no part;
    null is an entity value like any other. Other columns are ignored.
    """
    keys = [*entity, "_bucket"]
    longest = (
        intervals.filter(F.col("end_ms") > F.col("start_ms"))
        .select(*entity, F.floor(F.col("start_ms") / bucket_ms).alias("_bucket"), "start_ms", "end_ms")
        .groupBy(*keys, "start_ms")
        .agg(F.max("end_ms").alias("end_ms"))
    )
    # Staged: what follows reads it three times, and would parse the logs as often.
    ranked = stage(longest.groupBy(*keys).agg(F.sort_array(F.collect_list("start_ms")).alias("_starts"), F.sort_array(F.collect_list("end_ms")).alias("_ends")), "ranked")
    timeline = Window.partitionBy(*entity).orderBy("_bucket")

    def joined(rows: DataFrame, summary: DataFrame) -> DataFrame:
        right = summary.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
        return rows.join(right, on).drop(*(f"_r_{k}" for k in keys))

    carried = ranked.select(*keys, F.max(F.element_at("_ends", -1)).over(timeline.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    # A boundary is a start with a gap (or nothing) before it: its start, and the end before the gap.
    bounds = F.filter(
        F.transform(
            "_starts",
            lambda s, i: F.struct(s.alias("s"), F.when(i == 0, F.col("_carry")).otherwise(F.greatest("_carry", F.get("_ends", i - 1))).alias("before")),
        ),
        lambda b: b["before"].isNull() | (b["s"] > b["before"]),
    )
    cut = stage(joined(ranked, carried).select(*keys, bounds.alias("_bounds"), F.element_at("_ends", -1).alias("_last")), "cut")
    onward = cut.select(
        *keys,
        F.coalesce(
            F.first(F.get("_bounds", F.lit(0))["before"], ignorenulls=True).over(timeline.rowsBetween(1, Window.unboundedFollowing)),
            F.max("_last").over(Window.partitionBy(*entity)),
        ).alias("_onward"),
    )
    pieces = F.flatten(
        F.transform(
            "_bounds",
            lambda b, i: F.array(
                F.struct(F.lit("period").alias("kind"), b["s"].alias("start_ms"), F.coalesce(F.get("_bounds", i + 1)["before"], F.col("_onward")).alias("end_ms")),
                F.struct(F.lit("gap").alias("kind"), b["before"].alias("start_ms"), b["s"].alias("end_ms")),
            ),
        )
    )
    piece = F.col("_piece")
    return (
        joined(cut.filter(F.size("_bounds") > 0), onward)
        .select(*entity, F.explode(pieces).alias("_piece"))
        .filter(piece["start_ms"].isNotNull())
        .select(*entity, piece["kind"].alias("kind"), piece["start_ms"].alias("start_ms"), piece["end_ms"].alias("end_ms"))
    )


def speech_periods(logs: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Periods and gaps per (row_id, side, speaker) of a diarization log."""
    return periods_and_gaps(segments(logs, "segments_json", ["row_id", "side"]), ["row_id", "side", "speaker"], bucket_ms)
