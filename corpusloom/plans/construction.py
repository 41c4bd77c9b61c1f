"""Queries of corpus construction: scans, gates, segments, selection, splits, funnel, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.operators import diarization, incremental, relational, selection, statistics
from corpusloom.plans.catalogue import Catalogue
from corpusloom.plans.pipeline import Pipeline
from corpusloom.staging import stage, table

C = Catalogue()
MANIFEST, TRAIN, LOG, SCORES, STATS = "stage_00_aligned_pair_manifest", "train_metadata", "sortformer_audio_progress", "dnsmospro_quality_pairs", "filtering_stage_stats_summary"

_NORM = "CASE lower(trim({0})) WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE coalesce(lower(trim({0})), '') END"
_TRUE = "coalesce(lower(trim(CAST({0} AS VARCHAR))) IN ('1', 'true', 'yes', 'y'), false)"


# Languages, gates, sides ------------------------------------------------------------------


@C.add(f"SELECT {_NORM.format('src_lang')} AS language, count(*) AS n FROM stage_00_aligned_pair_manifest GROUP BY 1")
def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, MANIFEST).groupBy(X.normalize_language(F.col("src_lang")).alias("language")).agg(F.count("*").alias("n"))


@C.add(f"""SELECT line_no, {_NORM.format('src_lang')} = {_NORM.format('substr(sample_id, 1, 2)')} AS src_match,
  {_NORM.format('tgt_lang')} = {_NORM.format('substr(sample_id, 4, 2)')} AS tgt_match,
  ({_NORM.format('src_lang')} = {_NORM.format('substr(sample_id, 1, 2)')}) AND ({_NORM.format('tgt_lang')} = {_NORM.format('substr(sample_id, 4, 2)')}) AS both_match
  FROM stage_00_aligned_pair_manifest""")
def language_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, MANIFEST)
    src = relational.language_match(F.col("src_lang"), F.substring("sample_id", 1, 2))
    tgt = relational.language_match(F.col("tgt_lang"), F.substring("sample_id", 4, 2))
    return df.select("line_no", src.alias("src_match"), tgt.alias("tgt_match"), (src & tgt).alias("both_match"))


@C.add("""SELECT sample_id AS row_id, 'source' AS side, src_audio AS audio_path, src_text AS text FROM stage_00_aligned_pair_manifest
  UNION ALL SELECT sample_id, 'target', tgt_audio, tgt_text FROM stage_00_aligned_pair_manifest""")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return relational.to_sides(table(spark, sf, MANIFEST), "sample_id", {"audio_path": ("src_audio", "tgt_audio"), "text": ("src_text", "tgt_text")})


_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, side ORDER BY logged_at DESC, segments_json DESC NULLS LAST, status DESC) AS rn FROM sortformer_audio_progress) WHERE rn = 1"""


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, LOG)
    keep = ["row_id", "side", "logged_at", "segments_json", "status", "num_speakers", "secondary_ratio", "secondary_duration"]
    return incremental.latest_progress(log.select(*keep), ["row_id", "side"], ["logged_at", "segments_json", "status"])


@C.add(f"SELECT row_id, side, status, num_speakers, logged_at FROM ({_LATEST})")
def latest_progress(spark: SparkSession, sf: str) -> DataFrame:
    return _latest(spark, sf).select("row_id", "side", "status", "num_speakers", "logged_at")


@C.add(f"""WITH l AS ({_LATEST})
  SELECT row_id, max(CASE WHEN side = 'source' THEN status END) AS src_status, max(CASE WHEN side = 'target' THEN status END) AS tgt_status,
         max(CASE WHEN side = 'source' THEN num_speakers END) AS src_num_speakers, max(CASE WHEN side = 'target' THEN num_speakers END) AS tgt_num_speakers
  FROM l GROUP BY row_id""")
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    return relational.to_pairs(_latest(spark, sf), ["status", "num_speakers"]).select("row_id", "src_status", "tgt_status", "src_num_speakers", "tgt_num_speakers")


_GATE = f"""WITH l AS ({_LATEST}),
 g AS (SELECT row_id, side, status = 'done' AS done, coalesce(num_speakers = 1, false) AS strict,
       coalesce(num_speakers = 1, false) OR coalesce(secondary_ratio <= 0.05 AND secondary_duration <= 1.0, false) AS relaxed FROM l),
 p AS (SELECT row_id, coalesce(bool_or(strict) FILTER (side = 'source'), false) AND coalesce(bool_or(strict) FILTER (side = 'target'), false) AS both_strict_single,
       coalesce(bool_or(relaxed) FILTER (side = 'source'), false) AND coalesce(bool_or(relaxed) FILTER (side = 'target'), false) AS both_relaxed_single,
       coalesce(bool_or(done) FILTER (side = 'source'), false) AND coalesce(bool_or(done) FILTER (side = 'target'), false) AS both_done FROM g GROUP BY row_id)
"""


def _speaker_gate(spark: SparkSession, sf: str) -> DataFrame:
    sides = _latest(spark, sf).select(
        "row_id",
        "side",
        (F.col("status") == "done").alias("done"),
        relational.strict_single_speaker(F.col("num_speakers")).alias("strict"),
        relational.relaxed_single_speaker(F.col("num_speakers"), F.col("secondary_ratio"), F.col("secondary_duration")).alias("relaxed"),
    )
    both = lambda c: F.coalesce(F.col(f"src_{c}"), F.lit(False)) & F.coalesce(F.col(f"tgt_{c}"), F.lit(False))
    wide = relational.to_pairs(sides, ["done", "strict", "relaxed"])
    return wide.select("row_id", both("strict").alias("both_strict_single"), both("relaxed").alias("both_relaxed_single"), both("done").alias("both_done"))


@C.add(_GATE + "SELECT *, NOT both_done OR NOT both_relaxed_single AS either_multi_or_error FROM p")
def speaker_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _speaker_gate(spark, sf).withColumn("either_multi_or_error", ~F.col("both_done") | ~F.col("both_relaxed_single"))


@C.add(_GATE + "SELECT CASE WHEN both_strict_single THEN 'pass' ELSE 'fail' END AS result, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM p) AS share FROM p GROUP BY 1")
def pass_fail_partition(spark: SparkSession, sf: str) -> DataFrame:
    gate = stage(_speaker_gate(spark, sf), "gate")
    kept, dropped = relational.partition_by(gate, F.col("both_strict_single"))
    total = gate.count()
    parts = kept.select(F.lit("pass").alias("result")).unionByName(dropped.select(F.lit("fail").alias("result")))
    return parts.groupBy("result").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(float(max(total, 1))))


@C.add(f"SELECT {_TRUE.format('selected')} AS flag, count(*) AS n FROM dnsmospro_quality_pairs GROUP BY 1")
def truthy_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, SCORES).groupBy(X.truthy(F.col("selected")).alias("flag")).agg(F.count("*").alias("n"))


@C.add("""SELECT row_id, side, coalesce(strict_single_speaker, false) AND coalesce(relaxed_single_speaker, false) AND lower(status) IN ('1', 'true', 'yes', 'y', 'done', 'ok') AS success
  FROM sortformer_audio_progress""")
def preprocess_mask(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, LOG).select("row_id", "side", F.col("strict_single_speaker").alias("source_clearvoice_ok"), F.col("relaxed_single_speaker").alias("target_demucs_ok"), "status")
    return df.select("row_id", "side", relational.preprocess_success(df).alias("success"))


@C.add("""SELECT CASE WHEN coalesce(upper(status) LIKE '%FAIL%', false) THEN 'failed_status' WHEN coalesce(trim(source_audio), '') = '' THEN 'missing_source'
  WHEN coalesce(trim(hypo_audio), '') = '' THEN 'missing_target' END AS reason, count(*) AS n FROM evaluation_manifest GROUP BY 1""")
def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    reason = relational.skip_reason(F.col("source_audio"), F.col("hypo_audio"), F.col("status"))
    return table(spark, sf, "evaluation_manifest").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@C.add("SELECT line_no, sample_id FROM stage_00_aligned_pair_manifest WHERE length(src_audio) > 0 AND length(tgt_audio) > 0 AND src_text IS NOT NULL AND tgt_text IS NOT NULL")
def audio_present(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, MANIFEST).dropna(subset=["src_text", "tgt_text"])
    return df.filter((F.length("src_audio") > 0) & (F.length("tgt_audio") > 0)).select("line_no", "sample_id")


# Segments ---------------------------------------------------------------------------------

_KEYS = ["row_id", "side", "logged_at"]

#: The lists of all done rows in every notation, those that are empty or can't be read included.
_LISTS = r"""WITH done AS (SELECT DISTINCT row_id, side, logged_at, segments_json FROM sortformer_audio_progress WHERE status = 'done'),
 heads AS (SELECT row_id, side, logged_at, bool_or(segments_json IS NULL OR json_valid(segments_json)) AS readable FROM done GROUP BY ALL),
 raw AS (SELECT row_id, side, logged_at, CAST(segments_json AS JSON) AS j FROM done WHERE json_valid(segments_json)),
 one AS (SELECT row_id, side, logged_at, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END) AS e FROM raw),
 two AS (SELECT row_id, side, logged_at, unnest(CASE WHEN json_type(e) = 'ARRAY' AND (json_type(e, '$[0]') IN ('OBJECT', 'ARRAY') OR (e->>'$[0]') LIKE '% %') THEN CAST(e AS JSON[]) ELSE [e] END) AS e FROM one),
 parts AS (SELECT row_id, side, logged_at, e, json_type(e) AS kind, regexp_split_to_array(trim(replace(e->>'$', ',', ' ')), '\s+') AS p FROM two),
 s AS (SELECT row_id, side, logged_at,
   TRY_CAST(CASE kind WHEN 'OBJECT' THEN coalesce(e->>'start', e->>'begin', e->>'start_time') WHEN 'ARRAY' THEN e->>'$[0]' ELSE p[1] END AS DOUBLE) AS "start",
   TRY_CAST(CASE kind WHEN 'OBJECT' THEN coalesce(e->>'end', e->>'end_time') WHEN 'ARRAY' THEN e->>'$[1]' ELSE p[2] END AS DOUBLE) AS "end",
   CASE kind WHEN 'OBJECT' THEN coalesce(e->>'speaker', e->>'speaker_id', e->>'label') WHEN 'ARRAY' THEN e->>'$[2]' ELSE p[3] END AS speaker FROM parts),
 f AS (SELECT * FROM s WHERE "end" > "start" AND speaker IS NOT NULL)
"""


def _done_lists(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, LOG).filter(F.col("status") == "done").select(*_KEYS, "segments_json").distinct()
    return stage(diarization.segment_lists(log, _KEYS), "lists")


def _with_empty(lists: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with a row for every list's keys, and whether one of their lists could be read."""
    heads = lists.groupBy(*_KEYS).agg(F.bool_or(F.col("segments").isNotNull()).alias("readable"))
    right = found.withColumnsRenamed({k: f"_r_{k}" for k in _KEYS})
    return heads.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in _KEYS], "left").drop(*(f"_r_{k}" for k in _KEYS))


_NUMBERS = ("num_speakers", "num_segments", "speaker_switches", "total_labeled_duration", "dominant_duration", "secondary_duration", "secondary_ratio")


@C.add(_LISTS + """, per AS (SELECT row_id, side, logged_at, speaker, sum("end" - "start") AS seconds, count(*) AS segments, min(("start", "end")) AS first_seg FROM f GROUP BY ALL),
 w AS (SELECT *, row_number() OVER (PARTITION BY row_id, side, logged_at ORDER BY round(seconds, 6) DESC, first_seg, speaker) AS rn FROM per),
 t AS (SELECT row_id, side, logged_at, count(*) AS num_speakers, CAST(sum(segments) AS BIGINT) AS num_segments, sum(seconds) AS total FROM per GROUP BY ALL),
 sw AS (SELECT row_id, side, logged_at, count(*) FILTER (prev <> speaker) AS speaker_switches FROM (SELECT *, lag(speaker) OVER (PARTITION BY row_id, side, logged_at ORDER BY "start", "end", speaker) AS prev FROM f) GROUP BY ALL),
 a AS (SELECT t.row_id, t.side, t.logged_at, num_speakers, num_segments, speaker_switches, round(total, 6) AS total_labeled_duration, w.speaker AS dominant_speaker,
   round(w.seconds, 6) AS dominant_duration, round(total - w.seconds, 6) AS secondary_duration, round((total - w.seconds) / total, 6) AS secondary_ratio
 FROM t JOIN w ON w.rn = 1 AND w.row_id = t.row_id AND w.side = t.side AND w.logged_at = t.logged_at JOIN sw ON sw.row_id = t.row_id AND sw.side = t.side AND sw.logged_at = t.logged_at)
 SELECT h.row_id, h.side, h.logged_at, readable, dominant_speaker, """ + ", ".join(f"CASE WHEN readable THEN coalesce({c}, 0) END AS {c}" for c in _NUMBERS) + """
 FROM heads h LEFT JOIN a ON a.row_id IS NOT DISTINCT FROM h.row_id AND a.side IS NOT DISTINCT FROM h.side AND a.logged_at IS NOT DISTINCT FROM h.logged_at""")
def speaker_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Every done row: zero speakers for an empty list, nulls for one that can't be read."""
    lists = _done_lists(spark, sf)
    out = _with_empty(lists, diarization.analysis(lists.select(*_KEYS, F.inline("segments")), _KEYS))
    zero = {c: F.when(F.col("readable"), F.coalesce(F.round(c, 6) if t == "double" else F.col(c), F.lit(0).cast(t))) for c, t in out.dtypes if c in _NUMBERS}
    return out.select(*_KEYS, "readable", "dominant_speaker", *(zero[c].alias(c) for c in _NUMBERS))


@C.add(_LISTS + """SELECT row_id, side, logged_at, speaker, round(sum("end" - "start"), 6) AS seconds, count(*) AS segments FROM f GROUP BY ALL""")
def speaker_durations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _done_lists(spark, sf).select(*_KEYS, F.inline("segments"))
    return diarization.speaker_seconds(rows, _KEYS).select(*_KEYS, "speaker", F.round("seconds", 6).alias("seconds"), "segments")


@C.add(_LISTS + """, v AS (SELECT row_id, side, logged_at, string_agg("start" || ':' || "end", ' ' ORDER BY "start", "end", speaker) AS vad, round(max("end") - min("start"), 6) AS span FROM f GROUP BY ALL)
 SELECT h.row_id, h.side, h.logged_at, readable, CASE WHEN readable THEN coalesce(vad, '') END AS vad, span
 FROM heads h LEFT JOIN v ON v.row_id IS NOT DISTINCT FROM h.row_id AND v.side IS NOT DISTINCT FROM h.side AND v.logged_at IS NOT DISTINCT FROM h.logged_at""")
def vad_span(spark: SparkSession, sf: str) -> DataFrame:
    """Every done row: an empty text and no span for an empty list, nulls for one that can't be read."""
    parts = F.sort_array(F.flatten(F.collect_list("segments")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["start"].cast("string"), F.lit(":"), p["end"].cast("string"))), " ")
    strings = _done_lists(spark, sf).groupBy(*_KEYS).agg(F.bool_or(F.col("segments").isNotNull()).alias("readable"), text.alias("vad"))
    return strings.select(*_KEYS, "readable", F.when(F.col("readable"), F.col("vad")).alias("vad"), F.round(X.vad_span(F.col("vad")), 6).alias("span"))


@C.add("""SELECT row_id, side, logged_at, k AS speaker, CAST(json_extract(speaker_durations_json, '$."' || k || '"') AS DOUBLE) AS seconds
  FROM (SELECT row_id, side, logged_at, speaker_durations_json, unnest(json_keys(speaker_durations_json)) AS k FROM sortformer_audio_progress WHERE json_valid(speaker_durations_json))""")
def duration_map_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, LOG).select(*_KEYS, F.from_json("speaker_durations_json", "map<string,double>").alias("m"))
    return df.select(*_KEYS, F.explode("m").alias("speaker", "seconds"))


# Selection --------------------------------------------------------------------------------

_RECORDS = """WITH r AS (SELECT sample_id, max(CASE WHEN NOT isnan(combined_dnsmospro) THEN combined_dnsmospro END) AS score FROM dnsmospro_quality_pairs GROUP BY sample_id)
"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, SCORES).groupBy("sample_id").agg(F.max(X.no_nan(F.col("combined_dnsmospro"))).alias("score"))


@C.add(_RECORDS + "SELECT sample_id, score, coalesce(score >= 3.5, false) AS selected, CASE WHEN coalesce(score >= 3.5, false) THEN '' ELSE 'below_cutoff' END AS drop_reason FROM r")
def quality_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return selection.by_cutoff(_records(spark, sf), "score", 3.5)


_TOP = _RECORDS + ", t AS (SELECT sample_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, md5(sample_id), sample_id) <= 100 AS selected FROM r)\n"


@C.add(_TOP + "SELECT sample_id, score, selected, CASE WHEN selected THEN '' ELSE 'below_top_n_boundary' END AS drop_reason FROM t")
def quality_topn(spark: SparkSession, sf: str) -> DataFrame:
    return selection.top_n(_records(spark, sf), "score", 100, "sample_id")


@C.add(_TOP + "SELECT min(score) FILTER (selected) AS boundary, count(*) FILTER (selected) AS kept, count(*) FILTER (NOT selected) AS dropped FROM t")
def quality_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return selection.retained_boundary(quality_topn(spark, sf), "score")


@C.add("""SELECT CASE WHEN m.sample_id IS NULL THEN 'score_only' WHEN s.sample_id IS NULL THEN 'manifest_only' ELSE 'both' END AS found, count(*) AS ids
  FROM (SELECT DISTINCT sample_id FROM stage_00_aligned_pair_manifest) m FULL JOIN (SELECT DISTINCT sample_id FROM dnsmospro_quality_pairs) s USING (sample_id) GROUP BY 1""")
def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, MANIFEST).select("sample_id").distinct().withColumn("m", F.lit(1))
    s = table(spark, sf, SCORES).select("sample_id").distinct().withColumn("s", F.lit(1))
    found = F.when(F.col("m").isNull(), "score_only").when(F.col("s").isNull(), "manifest_only").otherwise("both")
    return m.join(s, "sample_id", "full").groupBy(found.alias("found")).agg(F.count("*").alias("ids"))


@C.add("SELECT DISTINCT sample_id FROM stage_00_aligned_pair_manifest EXCEPT SELECT sample_id FROM dnsmospro_quality_pairs")
def ids_without_score(spark: SparkSession, sf: str) -> DataFrame:
    return relational.coverage(table(spark, sf, MANIFEST), table(spark, sf, SCORES), "sample_id")[0]


@C.add("SELECT sample_id, count(*) AS copies FROM dnsmospro_quality_pairs GROUP BY sample_id HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    return relational.duplicates(table(spark, sf, SCORES), "sample_id").withColumnRenamed("count", "copies")


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY line_no) AS rn FROM stage_00_aligned_pair_manifest) WHERE rn = 1"


@C.add(f"SELECT line_no, sample_id, show_id FROM ({_FIRST})")
def drop_duplicates_first(spark: SparkSession, sf: str) -> DataFrame:
    return selection.first_per_key(table(spark, sf, MANIFEST).select("line_no", "sample_id", "show_id"), ["sample_id"], ["line_no"])


@C.add(_RECORDS + f"SELECT m.line_no, m.sample_id, r.score FROM ({_FIRST}) m JOIN r USING (sample_id)")
def covered_join(spark: SparkSession, sf: str) -> DataFrame:
    m = selection.first_per_key(table(spark, sf, MANIFEST).select("line_no", "sample_id"), ["sample_id"], ["line_no"])
    r = _records(spark, sf)
    m = stage(m.join(r.select("sample_id"), "sample_id", "left_semi"), "covered")
    return relational.covered_join(m, r, "sample_id", ["score"], allow_extra=True).select("line_no", "sample_id", "score")


# Splits, samples, shards --------------------------------------------------------------------

_HASHED = "row_number() OVER (ORDER BY md5('{seed}:' || {id}), {id}) - 1"


@C.add("""WITH r AS (SELECT DISTINCT sample_id FROM train_metadata), n AS (SELECT count(*) AS n FROM r), p AS (SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) - 1 AS pos FROM r)
 SELECT sample_id, CASE WHEN pos < 10 THEN 'test' WHEN pos < round_even(n * 0.12, 0) THEN 'dev' ELSE 'train' END AS split FROM p, n""")
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return selection.assign_splits(table(spark, sf, TRAIN).select("sample_id").distinct(), "sample_id", 0.12, 10)


@C.add("SELECT split, count(*) AS n FROM train_metadata WHERE split IN ('train', 'dev', 'test') GROUP BY split")
def split_existing(spark: SparkSession, sf: str) -> DataFrame:
    return selection.existing_split(table(spark, sf, TRAIN), "split").groupBy("split").agg(F.count("*").alias("n"))


@C.add("""WITH n AS (SELECT greatest(1, round_even(count(*) * 0.1, 0)) AS n FROM stage_00_aligned_pair_manifest),
 p AS (SELECT line_no, sample_id, row_number() OVER (ORDER BY md5('7:' || line_no), line_no) - 1 AS pos FROM stage_00_aligned_pair_manifest)
 SELECT line_no, sample_id FROM p, n WHERE pos < n""")
def sample_exact(spark: SparkSession, sf: str) -> DataFrame:
    return selection.sample_exact(table(spark, sf, MANIFEST).select("line_no", "sample_id"), "line_no", 0.1, seed=7)


@C.add("SELECT line_no, CAST((row_number() OVER (ORDER BY line_no) - 1) % 8 AS INTEGER) AS shard FROM stage_00_aligned_pair_manifest")
def shard_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return selection.shards(table(spark, sf, MANIFEST).select("line_no"), ["line_no"], 8)


@C.add("SELECT line_no, CAST((row_number() OVER (ORDER BY line_no) - 1) // 32 AS BIGINT) AS batch FROM stage_00_aligned_pair_manifest")
def batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    return selection.batches(table(spark, sf, MANIFEST).select("line_no"), ["line_no"], 32)


@C.add("SELECT line_no, CASE WHEN row_number() OVER (ORDER BY line_no) - 1 < greatest(1, (SELECT count(*) // 2 FROM stage_00_aligned_pair_manifest)) THEN 0 ELSE 1 END AS half FROM stage_00_aligned_pair_manifest")
def half_split(spark: SparkSession, sf: str) -> DataFrame:
    return selection.halves(table(spark, sf, MANIFEST).select("line_no"), ["line_no"])


@C.add("""SELECT line_no, '/out/pairs/vc_' || sample_id || '.wav' AS output, '/out/shard' || printf('%03d', line_no % 8) || '/wav/' || regexp_extract(src_audio, '([^/]*)$', 1) AS shard_output
  FROM stage_00_aligned_pair_manifest""")
def output_paths(spark: SparkSession, sf: str) -> DataFrame:
    out = relational.output_path(F.col("sample_id"), "/out/pairs", "vc_")
    shard = relational.shard_path(F.col("src_audio"), (F.col("line_no") % 8).cast("int"), "/out", "wav")
    return table(spark, sf, MANIFEST).select("line_no", out.alias("output"), shard.alias("shard_output"))


# Funnel -------------------------------------------------------------------------------------

_STAGES = """WITH st(stage, k) AS (VALUES ('Raw aligned dubbing manifest', 0), ('After denoise and vocal extraction', 1), ('After language filtering', 2), ('After single-speaker gate', 3), ('After quality selection', 4), ('Training split', 5)),
 s AS (SELECT regexp_replace(lower(trim(language_pair)), '[^a-z]+', '_', 'g') AS pair, f.stage, k, num_pairs, source_hours, target_hours FROM filtering_stage_stats_summary f JOIN st ON st.stage = f.stage)
"""
STAGES = ["Raw aligned dubbing manifest", "After denoise and vocal extraction", "After language filtering", "After single-speaker gate", "After quality selection", "Training split"]


@C.add(_STAGES + """SELECT pair, stage, k, num_pairs, CASE WHEN stage <> 'Training split' AND lag(num_pairs) OVER w > 0 THEN round(num_pairs::DOUBLE / lag(num_pairs) OVER w, 9) END AS retention_from_previous_stage
 FROM s WINDOW w AS (PARTITION BY pair ORDER BY k)""")
def stage_retention(spark: SparkSession, sf: str) -> DataFrame:
    at = F.create_map(*[F.lit(x) for k, s in enumerate(STAGES) for x in (s, k)])
    pair = F.regexp_replace(F.lower(F.trim("language_pair")), "[^a-z]+", "_")
    rows = table(spark, sf, STATS).select(pair.alias("pair"), "stage", at[F.col("stage")].alias("k"), "num_pairs")
    return statistics.with_retention(rows, "pair", "k", "stage", ("Training split",)).withColumn("retention_from_previous_stage", F.round("retention_from_previous_stage", 9))


_FUNNEL = f"""WITH m AS ({_FIRST}), l AS ({_LATEST}), sc AS (SELECT sample_id, max(CASE WHEN NOT isnan(combined_dnsmospro) THEN combined_dnsmospro END) AS score FROM dnsmospro_quality_pairs GROUP BY 1),
 sp AS (SELECT row_id, coalesce(bool_or(num_speakers = 1) FILTER (side = 'source'), false) AND coalesce(bool_or(num_speakers = 1) FILTER (side = 'target'), false) AS strict FROM l GROUP BY 1),
 d AS (SELECT row_id, max(total_labeled_duration) FILTER (side = 'source') AS src_sec, max(total_labeled_duration) FILTER (side = 'target') AS tgt_sec FROM (SELECT DISTINCT row_id, side, total_labeled_duration FROM sortformer_audio_progress) GROUP BY 1),
 f AS (SELECT substr(m.sample_id, 1, 5) AS pair, src_sec, tgt_sec,
   ({_NORM.format('src_lang')} = {_NORM.format('substr(m.sample_id, 1, 2)')} AND {_NORM.format('tgt_lang')} = {_NORM.format('substr(m.sample_id, 4, 2)')}) AS lang_ok, coalesce(strict, false) AS spk_ok, coalesce(score >= 3.5, false) AS q_ok,
   m.sample_id IN (SELECT sample_id FROM train_metadata WHERE sample_id IS NOT NULL) AS t_ok
   FROM m LEFT JOIN sp ON sp.row_id = m.sample_id LEFT JOIN sc ON sc.sample_id = m.sample_id LEFT JOIN d ON d.row_id = m.sample_id),
 x AS (SELECT pair, 'raw' AS stage, 0 AS k, src_sec, tgt_sec FROM f UNION ALL SELECT pair, 'language', 1, src_sec, tgt_sec FROM f WHERE lang_ok
   UNION ALL SELECT pair, 'speaker', 2, src_sec, tgt_sec FROM f WHERE lang_ok AND spk_ok UNION ALL SELECT pair, 'quality', 3, src_sec, tgt_sec FROM f WHERE lang_ok AND spk_ok AND q_ok
   UNION ALL SELECT pair, 'training', 4, src_sec, tgt_sec FROM f WHERE lang_ok AND spk_ok AND q_ok AND t_ok),
 a AS (SELECT pair, stage, k, count(*) AS num_pairs, coalesce(sum(src_sec), 0) AS s, coalesce(sum(tgt_sec), 0) AS t FROM x GROUP BY ALL)
 SELECT pair, stage, k, num_pairs, round(s / 3600, 9) AS source_hours, round(t / 3600, 9) AS target_hours, round((s + t) / 3600, 9) AS total_hours, round(s / num_pairs, 10) AS avg_source_duration_sec,
   round(t / num_pairs, 10) AS avg_target_duration_sec,
   CASE WHEN stage <> 'training' THEN round(num_pairs::DOUBLE / lag(num_pairs) OVER (PARTITION BY pair ORDER BY k), 9) END AS retention_from_previous_stage FROM a"""


def _gated(spark: SparkSession, sf: str) -> Pipeline:
    """The whole manifest with its gates; the tables have no flags for the denoise stage."""
    m = selection.first_per_key(table(spark, sf, MANIFEST).select("line_no", "sample_id", "src_lang", "tgt_lang"), ["sample_id"], ["line_no"])
    latest = relational.to_pairs(_latest(spark, sf), ["num_speakers"])
    seconds = relational.to_pairs(table(spark, sf, LOG).groupBy("row_id", "side").agg(F.max("total_labeled_duration").alias("sec")), ["sec"])
    lang = relational.language_match(F.col("src_lang"), F.substring("sample_id", 1, 2)) & relational.language_match(F.col("tgt_lang"), F.substring("sample_id", 4, 2))
    speaker = relational.strict_single_speaker(F.col("src_num_speakers")) & relational.strict_single_speaker(F.col("tgt_num_speakers"))
    joined = m.join(latest.withColumnRenamed("row_id", "sample_id"), "sample_id", "left").join(seconds.withColumnRenamed("row_id", "sample_id"), "sample_id", "left").join(_records(spark, sf), "sample_id", "left")
    return Pipeline(joined).gate("language", lang).gate("speaker", speaker).gate("quality", F.col("score") >= 3.5)


def _funnel(gated: Pipeline) -> DataFrame:
    out = gated.funnel(F.substring("sample_id", 1, 5), F.col("src_sec"), F.col("tgt_sec"))
    digits = {"source_hours": 9, "target_hours": 9, "total_hours": 9, "avg_source_duration_sec": 10, "avg_target_duration_sec": 10}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()} | {"retention_from_previous_stage": F.round("retention_from_previous_stage", 9)})


@C.add(_FUNNEL)
def construction_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel down to the training split, which has no retention, as in the stage table."""
    gated = _gated(spark, sf)
    train = table(spark, sf, TRAIN).select("sample_id").distinct().withColumn("in_training", F.lit(True))
    gated.rows = gated.rows.join(train, "sample_id", "left")
    out = _funnel(gated.gate("training", F.col("in_training")))
    return out.withColumn("retention_from_previous_stage", F.when(F.col("stage") != "training", F.col("retention_from_previous_stage")))


@C.add(_STAGES + "SELECT a.pair, a.num_pairs, b.num_pairs AS expected_num_pairs FROM s a JOIN s b ON a.pair = b.pair AND a.k = 4 AND b.k = 5 WHERE a.num_pairs <> b.num_pairs OR abs(a.source_hours - b.source_hours) > 0.02")
def stage_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.regexp_replace(F.lower(F.trim("language_pair")), "[^a-z]+", "_")
    rows = table(spark, sf, STATS).select(pair.alias("pair"), "stage", "num_pairs", "source_hours")
    got = rows.filter(F.col("stage") == STAGES[4]).drop("stage")
    want = rows.filter(F.col("stage") == STAGES[5]).drop("stage")
    return statistics.mismatches(got, want, ["pair"], ["source_hours"]).select("pair", "num_pairs", "expected_num_pairs")


# Resume -------------------------------------------------------------------------------------


@C.add(f"""WITH l AS ({_LATEST}), w AS (SELECT DISTINCT sample_id AS row_id, side FROM stage_00_aligned_pair_manifest, (VALUES ('source'), ('target')) v(side))
 SELECT w.row_id, w.side FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.row_id = w.row_id AND l.side = w.side AND l.status = 'done')""")
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, MANIFEST).select(F.col("sample_id").alias("row_id")).distinct()
    work = ids.select("row_id", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side"))
    log = table(spark, sf, LOG).select("row_id", "side", "logged_at", "segments_json", "status")
    return incremental.pending(work, log, ["row_id", "side"], ["logged_at", "segments_json", "status"], rerun_errors=True)


@C.add("""SELECT line_no, length(src_text) AS n_chars, length(regexp_replace(src_text, '[^ ]', '', 'g')) AS n_blanks FROM stage_00_aligned_pair_manifest""")
def memoised_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, MANIFEST).select("line_no", "src_text")
    score = lambda d: d.withColumn("n_chars", F.length("src_text").cast("bigint")).withColumn("n_blanks", F.length(F.regexp_replace("src_text", "[^ ]", "")).cast("bigint"))
    return incremental.memoised(rows, "src_text", score).drop("src_text")


@C.add("""WITH a AS (SELECT sample_id, max(CASE WHEN NOT isnan(src_dnsmospro) THEN src_dnsmospro END) AS v FROM dnsmospro_quality_pairs GROUP BY 1),
 b AS (SELECT row_id, max(total_labeled_duration) AS v FROM sortformer_audio_progress WHERE side = 'source' GROUP BY 1)
 SELECT m.line_no, m.sample_id, coalesce(a.v, b.v) AS v FROM stage_00_aligned_pair_manifest m LEFT JOIN a USING (sample_id) LEFT JOIN b ON b.row_id = m.sample_id""")
def coalesced_lookup(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, SCORES).groupBy("sample_id").agg(F.max(X.no_nan(F.col("src_dnsmospro"))).alias("v"))
    b = table(spark, sf, LOG).filter("side = 'source'").groupBy(F.col("row_id").alias("sample_id")).agg(F.max("total_labeled_duration").alias("v"))
    return incremental.coalesced(table(spark, sf, MANIFEST).select("line_no", "sample_id"), "sample_id", [a, b], "v")


QUERIES, SQL = C.queries, C.sql
