"""The queries of the general operators: intervals (p3) and records that fail to parse (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.intervals import speech_periods
from corpusloom.sources.records import loaded, parse_records, rejected
from corpusloom.staging import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech_periods(table(spark, sf_dir, "sortformer_audio_progress"))


def p3_speaker_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech, silence and their number per speaker, each moment counted once."""
    length = F.col("end_ms") - F.col("start_ms")
    speech = F.col("kind") == "period"
    return (
        speech_periods(table(spark, sf_dir, "sortformer_audio_progress"))
        .groupBy("row_id", "side", "speaker")
        .agg(
            F.sum(F.when(speech, length)).alias("speech_ms"),
            F.count_if(speech).alias("periods"),
            F.coalesce(F.sum(F.when(~speech, length)), F.lit(0)).alias("gap_ms"),
            F.count_if(~speech).alias("gaps"),
        )
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(table(spark, sf_dir, "stage_00_raw_records"), "record_no", "raw_line")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(_records(spark, sf_dir), "record_no")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(_records(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p3_found, p3_speaker_time, p4_found, p4_loaded)}

_FIELDS_SQL = r"""
lines AS (SELECT record_no, regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS line FROM stage_00_raw_records),
formed AS (
  SELECT record_no, line,
         regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS quoted_well,
         regexp_extract_all(chr(9) || line, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1) AS raw_fields
  FROM lines),
fields AS (
  SELECT record_no, quoted_well,
         [CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN raw_fields] AS f
  FROM formed),
judged AS (
  SELECT record_no, f,
         CASE WHEN NOT quoted_well THEN 'quoting'
              WHEN len(f) <> 7 THEN 'column_count'
              WHEN NOT regexp_matches(f[4], '\pL') OR NOT regexp_matches(f[5], '\pL')
                OR regexp_full_match(f[4], '(?is)\s*(na|n/a|null|none|nan)\s*') OR regexp_full_match(f[5], '(?is)\s*(na|n/a|null|none|nan)\s*')
                OR contains(f[4], chr(65533)) OR contains(f[5], chr(65533))
                OR NOT suffix(lower(f[2]), '.wav') THEN 'value' END AS reason
  FROM fields)
"""

#: A JSON value's segments: a single one, or a list of objects, triples and texts, or such a list within a list.
_P3 = r"""
WITH raw AS (SELECT row_id, side, CAST(segments_json AS JSON) AS j FROM sortformer_audio_progress WHERE json_valid(segments_json)),
one AS (SELECT row_id, side, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END) AS e FROM raw),
two AS (SELECT row_id, side, unnest(CASE WHEN json_type(e) = 'ARRAY' AND (json_type(e, '$[0]') IN ('OBJECT', 'ARRAY') OR (e->>'$[0]') LIKE '% %') THEN CAST(e AS JSON[]) ELSE [e] END) AS e FROM one),
parts AS (
  SELECT row_id, side, e, json_type(e) AS kind, regexp_split_to_array(trim(replace(e->>'$', ',', ' ')), '\s+') AS p FROM two),
read AS (
  SELECT row_id, side,
    TRY_CAST(CASE kind WHEN 'OBJECT' THEN coalesce(e->>'start', e->>'begin', e->>'start_time') WHEN 'ARRAY' THEN e->>'$[0]' ELSE p[1] END AS DOUBLE) AS s,
    TRY_CAST(CASE kind WHEN 'OBJECT' THEN coalesce(e->>'end', e->>'end_time') WHEN 'ARRAY' THEN e->>'$[1]' ELSE p[2] END AS DOUBLE) AS t,
    CASE kind WHEN 'OBJECT' THEN coalesce(e->>'speaker', e->>'speaker_id', e->>'label') WHEN 'ARRAY' THEN e->>'$[2]' ELSE p[3] END AS speaker
  FROM parts),
ms AS (SELECT DISTINCT row_id, side, speaker, CAST(round_even(s * 1000, 0) AS BIGINT) AS s, CAST(round_even(t * 1000, 0) AS BIGINT) AS t FROM read WHERE speaker IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL),
seen AS (SELECT *, max(t) OVER (PARTITION BY row_id, side, speaker ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ms WHERE t > s),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, side, speaker ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM seen),
periods AS (SELECT row_id, side, speaker, k, min(s) AS s, max(t) AS t FROM numbered GROUP BY ALL),
found AS (
  SELECT row_id, side, speaker, 'period' AS kind, s AS start_ms, t AS end_ms FROM periods
  UNION ALL SELECT a.row_id, a.side, a.speaker, 'gap', a.t, b.s FROM periods a JOIN periods b ON a.row_id = b.row_id AND a.side = b.side AND a.speaker = b.speaker AND b.k = a.k + 1)
"""

SQL = {
    "p3_found": _P3 + "SELECT * FROM found",
    "p3_speaker_time": _P3 + """SELECT row_id, side, speaker, CAST(sum(end_ms - start_ms) FILTER (kind = 'period') AS BIGINT) AS speech_ms, count(*) FILTER (kind = 'period') AS periods,
        coalesce(CAST(sum(end_ms - start_ms) FILTER (kind = 'gap') AS BIGINT), 0) AS gap_ms, count(*) FILTER (kind = 'gap') AS gaps FROM found GROUP BY ALL""",
    "p4_found": f"WITH {_FIELDS_SQL} SELECT record_no, reason FROM judged WHERE reason IS NOT NULL",
    "p4_loaded": f"""WITH {_FIELDS_SQL} SELECT record_no, f[1] AS sample_id, f[2] AS src_audio, f[3] AS tgt_audio, f[4] AS src_text,
                    f[5] AS tgt_text, f[6] AS src_lang, f[7] AS tgt_lang FROM judged WHERE reason IS NULL""",
}
