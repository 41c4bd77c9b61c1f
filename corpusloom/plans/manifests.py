"""Queries of manifests: schemas, files read and written, joins with fallbacks, resumed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.operators import incremental, relational, selection
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources import tsv
from corpusloom.staging import new_folder, stage, table

C = Catalogue()
MANIFEST, TRAIN, LOG, SCORES, STATS, EVAL = "stage_00_aligned_pair_manifest", "train_metadata", "sortformer_audio_progress", "dnsmospro_quality_pairs", "filtering_stage_stats_summary", "evaluation_manifest"

_TEXT = "coalesce({0}, '')"


# Schemas ----------------------------------------------------------------------------------


@C.add("SELECT line_no AS id, src_text, '' AS reference_text, '' AS hypothesis FROM stage_00_aligned_pair_manifest")
def schema_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Existing columns in the wanted order, recogniser output dropped, missing texts added, the id renamed."""
    df = table(spark, sf, MANIFEST).withColumns({"src_whisper": F.lit("x"), "tgt_asr": F.lit("x"), "out_sentence": F.lit("x"), "a_asr_b": F.lit("x")})
    kept = relational.drop_recognised(relational.existing(df, ["line_no", "absent", "src_text", "src_whisper", "tgt_asr", "out_sentence", "a_asr_b"]))
    filled = relational.add_missing_text(kept, ["src_text", "reference_text", "hypothesis"])
    return filled.withColumnRenamed(relational.resolve_id(filled, "line_no"), "id")


@C.add("SELECT line_no, CASE WHEN src_audio LIKE '/%' THEN src_audio ELSE '/corpus/' || src_audio END AS absolute, '/corpus/' || ltrim(src_audio, '/') AS joined FROM stage_00_aligned_pair_manifest WHERE trim(src_audio) <> ''")
def resolved_paths(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, MANIFEST).filter(X.strip(F.col("src_audio")) != "")
    return df.select("line_no", relational.resolved_path(F.col("src_audio"), "/corpus/").alias("absolute"), relational.resolved_path(F.ltrim("src_audio", F.lit("/")), "/corpus").alias("joined"))


@C.add(r"SELECT line_no, CASE WHEN regexp_matches(src_text, '[^\s\pZ\x{0B}\x{85}]') THEN src_text END AS src_text, CASE WHEN regexp_matches(tgt_audio, '[^\s\pZ\x{0B}\x{85}]') THEN tgt_audio END AS tgt_audio FROM stage_00_aligned_pair_manifest")
def passthrough_columns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, MANIFEST).select("line_no", *[relational.passthrough(F.col(c)).alias(c) for c in ("src_text", "tgt_audio")])


@C.add("""WITH r AS (SELECT DISTINCT sample_id, src_text, split FROM train_metadata)
 SELECT m.line_no, m.sample_id, m.src_text, r.src_text AS aligned_src_text, r.split FROM stage_00_aligned_pair_manifest m LEFT JOIN r USING (sample_id)""")
def metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    aligned = table(spark, sf, TRAIN).select("sample_id", "src_text", "split").distinct()
    return relational.join_metadata(table(spark, sf, MANIFEST).select("line_no", "sample_id", "src_text"), aligned, "sample_id", "sample_id")


# Joins with fallbacks -----------------------------------------------------------------------

_SIDE = "(SELECT row_id, max(num_speakers) AS num_speakers FROM sortformer_audio_progress WHERE side = '{0}' GROUP BY 1)"


def _sides(spark: SparkSession, sf: str, key: str) -> tuple[DataFrame, DataFrame]:
    log = table(spark, sf, LOG)
    a, b = (log.filter(F.col("side") == s).groupBy(F.col("row_id").alias(key)).agg(F.max("num_speakers").alias("num_speakers")) for s in ("source", "target"))
    return a, b


@C.add(f"SELECT s.row_id AS path, s.num_speakers, t.num_speakers AS num_speakers_tgt FROM {_SIDE.format('source')} s JOIN {_SIDE.format('target')} t USING (row_id)")
def annotation_join(spark: SparkSession, sf: str) -> DataFrame:
    """Joined on the first of the id columns that both have."""
    a, b = _sides(spark, sf, "path")
    return relational.join_annotations(a, b, ["path"], ["path"])


@C.add(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM {_SIDE.format('source')}), t AS (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM {_SIDE.format('target')})
 SELECT k - 1 AS position, s.row_id AS src, t.row_id AS tgt, s.num_speakers, t.num_speakers AS num_speakers_tgt FROM s JOIN t USING (k)""")
def annotation_join_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """Without a common id column the order decides."""
    a, b = (df.withColumnRenamed("key", name) for df, name in zip(_sides(spark, sf, "key"), ("src", "tgt")))
    return relational.join_annotations(a, b, ["src"], ["tgt"])


_IDS = "(SELECT DISTINCT sample_id FROM evaluation_manifest WHERE sample_id IS NOT NULL)"


@C.add(f"SELECT row_number() OVER (ORDER BY sample_id) - 1 AS position, sample_id, upper(sample_id) AS value FROM {_IDS}")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and metric values of one length, put together by their order."""
    ids = table(spark, sf, EVAL).select("sample_id").dropna().distinct()
    values = ids.select(F.upper("sample_id").alias("value"))
    return relational.zip_positional(ids, values, ["sample_id"], ["value"]).select("position", "sample_id", "value")


@C.add(f"SELECT sample_id, length(sample_id) AS chars, md5(upper(sample_id)) AS digest FROM {_IDS}")
def scores_by_id_or_position(spark: SparkSession, sf: str) -> DataFrame:
    """Rates have ids and are joined by them; pauses have none, and as many rows."""
    ids = table(spark, sf, EVAL).select("sample_id").dropna().distinct()
    rates = ids.select("sample_id", F.length("sample_id").cast("bigint").alias("chars"))
    pauses = ids.select(F.upper("sample_id").alias("line"), F.md5(F.upper("sample_id")).alias("digest"))
    withrates = relational.join_by_id_or_position(ids, rates, "sample_id", ["sample_id"], [])
    return relational.join_by_id_or_position(withrates, pauses, "sample_id", ["sample_id"], ["line"])


_CACHES = """WITH src AS (SELECT src_audio AS p, min(src_text) AS t FROM stage_00_aligned_pair_manifest WHERE src_text IS NOT NULL GROUP BY 1),
 tgt AS (SELECT tgt_audio AS p, min(tgt_text) AS t FROM stage_00_aligned_pair_manifest WHERE tgt_text IS NOT NULL GROUP BY 1),
 bad AS (SELECT DISTINCT audio_path AS p FROM sortformer_audio_progress WHERE status = 'error' AND audio_path IS NOT NULL),
 more AS (SELECT audio_path AS p, max(dominant_speaker) AS t FROM sortformer_audio_progress WHERE dominant_speaker IS NOT NULL GROUP BY 1)
"""


def _caches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    m, log = table(spark, sf, MANIFEST), table(spark, sf, LOG)
    side = lambda s: m.filter(f"{s}_text is not null and {s}_audio is not null").groupBy(F.col(f"{s}_audio").alias("p")).agg(F.min(f"{s}_text").alias("t"))
    bad = log.filter("status = 'error' and audio_path is not null").select("audio_path").distinct()
    more = log.filter("dominant_speaker is not null").groupBy("audio_path").agg(F.max("dominant_speaker"))
    return side("src"), side("tgt"), bad, more


@C.add(_CACHES + """SELECT m.line_no, src.t AS sentence, tgt.t AS translation, coalesce(more.t, '') AS extra FROM stage_00_aligned_pair_manifest m
 JOIN src ON src.p = m.src_audio JOIN tgt ON tgt.p = m.tgt_audio LEFT JOIN more ON more.p = m.src_audio
 WHERE m.src_audio NOT IN (SELECT p FROM bad) AND m.tgt_audio NOT IN (SELECT p FROM bad)""")
def text_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with both sides transcribed and neither failed; a further transcript is empty where there is none."""
    src, tgt, bad, more = _caches(spark, sf)
    pairs = table(spark, sf, MANIFEST).select("line_no", "src_audio", "tgt_audio")
    out = incremental.assembled(pairs, {"sentence": ("src_audio", src, bad), "translation": ("tgt_audio", tgt, bad)}, ("src_audio", more, "extra"))
    return out.select("line_no", "sentence", "translation", "extra")


@C.add(_CACHES + "SELECT DISTINCT audio_path FROM sortformer_audio_progress WHERE audio_path IS NOT NULL AND audio_path NOT IN (SELECT p FROM bad) AND audio_path NOT IN (SELECT p FROM src WHERE p IS NOT NULL)")
def uncached_audio(spark: SparkSession, sf: str) -> DataFrame:
    src, _, bad, _ = _caches(spark, sf)
    wanted = table(spark, sf, LOG).select("audio_path").dropna().distinct()
    return incremental.not_cached(wanted, "audio_path", src.withColumnRenamed("p", "audio_path"), bad)


@C.add("""WITH m AS (SELECT sample_id, count(*) AS n FROM stage_00_aligned_pair_manifest GROUP BY 1), s AS (SELECT sample_id, count(*) AS n FROM dnsmospro_quality_pairs GROUP BY 1)
 SELECT 'duplicates in manifest' AS "check", count(*) AS n FROM m WHERE n > 1 UNION ALL SELECT 'duplicates in scores', count(*) FROM s WHERE n > 1
 UNION ALL SELECT 'missing', count(*) FROM m ANTI JOIN s USING (sample_id) UNION ALL SELECT 'extra', count(*) FROM s ANTI JOIN m USING (sample_id)""")
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    """What stops the covered join of the whole tables."""
    return relational.coverage_report(table(spark, sf, MANIFEST), table(spark, sf, SCORES), "sample_id")


@C.add("""SELECT o_orderkey, index, CASE WHEN index IS NULL THEN 'no index' WHEN e.vec_id IS NULL THEN 'out of range' WHEN dim <> len(e.embedding) THEN 'dimension' END AS fault
 FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS index, CASE WHEN o_orderstatus = 'F' THEN 63 ELSE 64 END AS dim FROM orders) o LEFT JOIN embeddings e ON e.vec_id = o.index""")
def vector_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Indices that are missing or beyond the table, and vectors of another dimension, reported in place of raised."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("index"), F.when(F.col("o_orderstatus") == "F", 63).otherwise(64).alias("dim"))
    return relational.indexed_vectors(rows, table(spark, sf, "embeddings"), "index", "vec_id", "embedding", "dim", report=True).select("o_orderkey", "index", "fault")


# Files ---------------------------------------------------------------------------------------


@C.add(f"SELECT CAST(line_no AS VARCHAR) AS line_no, {', '.join(f'{_TEXT.format(c)} AS {c}' for c in ('sample_id', 'src_text', 'tgt_text'))} FROM stage_00_aligned_pair_manifest")
def csv_with_commas(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "csv")
    tsv.write_tsv(table(spark, sf, MANIFEST).select(F.col("line_no").cast("string"), "sample_id", "src_text", "tgt_text"), path, sep=",")
    return tsv.read_tsv(spark, path, "strings", sep=",", multiline=True)


@C.add(f"""SELECT sample_id, {_TEXT.format('src_text')} AS src_text, {_TEXT.format('tgt_text')} AS tgt_text, 'manifest' AS origin, '' AS split FROM stage_00_aligned_pair_manifest
 UNION ALL SELECT sample_id, {_TEXT.format('src_text')}, {_TEXT.format('tgt_text')}, '', {_TEXT.format('split')} FROM train_metadata""")
def files_united_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Files of unequal columns in unequal order, with tabs, quotes and line breaks in their texts."""
    root = new_folder(spark, "parts")
    tsv.write_tsv(table(spark, sf, MANIFEST).select("sample_id", "src_text", "tgt_text", F.lit("manifest").alias("origin")), f"{root}/a")
    tsv.write_tsv(table(spark, sf, TRAIN).select("tgt_text", "split", "sample_id", "src_text"), f"{root}/b")
    return tsv.read_tsv(spark, [f"{root}/a", f"{root}/b"], "strings", multiline=True)


@C.add("SELECT CAST(row_number() OVER (ORDER BY line_no) - 1 AS VARCHAR) AS id, coalesce(src_audio, '') AS source, coalesce(tgt_audio, '') AS target, coalesce(sample_id, '') AS output FROM stage_00_aligned_pair_manifest")
def pairs_without_id(spark: SparkSession, sf: str) -> DataFrame:
    """A file of the three older columns; the number of the row is its id."""
    path = new_folder(spark, "pairs")
    rows = table(spark, sf, MANIFEST).repartition(1).sortWithinPartitions("line_no")
    tsv.write_tsv(rows.select(F.col("src_audio").alias("source"), F.col("tgt_audio").alias("target"), F.col("sample_id").alias("output")), path)
    return tsv.read_pairs(spark, path)


@C.add("SELECT coalesce(src_text, '') AS source, coalesce(tgt_text, '') AS target, count(*) AS n FROM stage_00_aligned_pair_manifest GROUP BY ALL")
def headerless_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "headerless")
    tsv.write_tsv(table(spark, sf, MANIFEST).select("src_text", "tgt_text"), path, header=False)
    return tsv.read_tsv(spark, path, "strings", columns=["source", "target"], multiline=True).groupBy("source", "target").agg(F.count("*").alias("n"))


@C.add("""SELECT row_id || '::' || side AS audio_path, arg_max(total_labeled_duration, (logged_at, total_labeled_duration)) AS duration_sec FROM sortformer_audio_progress
 WHERE total_labeled_duration IS NOT NULL AND NOT isnan(total_labeled_duration) GROUP BY 1""")
def duration_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A cache in which keys repeat with other values: the last readable row wins."""
    path = new_folder(spark, "cache")
    log = table(spark, sf, LOG).select(F.concat_ws("::", "row_id", "side").alias("audio_path"), F.col("total_labeled_duration").alias("duration_sec"), "logged_at")
    tsv.write_tsv(log.repartition(1).sortWithinPartitions("logged_at", "duration_sec").select("audio_path", F.col("duration_sec").cast("string")), path)
    return tsv.read_cache(spark, path, "audio_path", "duration_sec", number=True)


@C.add("SELECT row_id, side, coalesce(status, '') AS status, coalesce(error, '') AS error FROM sortformer_audio_progress")
def appended_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log to which the two sides are appended one after the other."""
    path = new_folder(spark, "log")
    log = table(spark, sf, LOG).select("row_id", "side", "status", "error")
    for side in ("source", "target"):
        tsv.append_tsv(log.filter(F.col("side") == side), path)
    return tsv.read_tsv(spark, path, "strings", multiline=True)


@C.add("SELECT CAST(count(*) AS VARCHAR) AS num_rows, CAST(count(DISTINCT sample_id) AS VARCHAR) AS ids, 'dnsmos' AS metric FROM dnsmospro_quality_pairs")
def summary_twin(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON summary and its TSV of one row, which is returned; both say the same."""
    n = table(spark, sf, SCORES).agg(F.count("*"), F.count_distinct("sample_id")).first()
    path = new_folder(spark, "summary")
    tsv.write_summary({"num_rows": n[0], "ids": n[1], "metric": "dnsmos"}, spark, path)
    row = tsv.read_tsv(spark, f"{path}.tsv", "strings")
    if {k: str(v) for k, v in tsv.read_summary(spark, path).items()} != row.first().asDict():
        raise ValueError("the summaries differ")
    return row


@C.add("SELECT count(*) AS lines, count(*) FILTER (WHERE contains(src_audio, '/data/dubs')) AS rewritten FROM stage_00_aligned_pair_manifest WHERE src_audio IS NOT NULL")
def release_copy(spark: SparkSession, sf: str) -> DataFrame:
    """A compressed copy with other paths, and the number of its lines."""
    path = new_folder(spark, "copy")
    lines = table(spark, sf, MANIFEST).select(F.col("src_audio").alias("value")).dropna()
    n = tsv.copied(lines, {"/data/dubs": "<ROOT>", "/data/dubs/en_es": "<EN_ES>"}, path, "gzip")
    changed = spark.read.text(path).agg(F.count_if(F.col("value").contains("<ROOT>") | F.col("value").contains("<EN_ES>")).alias("rewritten"))
    return changed.select(F.lit(n).cast("bigint").alias("lines"), "rewritten")


_INVENTORY = ", ".join(f"'{v}' AS {k}" if v is not None else f"'' AS {k}" for k, v in (("source_path", None), ("kind", "stage"), ("required", "True"), ("status", None), ("bytes", None), ("note", None)))


@C.add(f"SELECT language_pair, stage, {_INVENTORY}, '<ROOT>/' || stage AS release_path, CAST(num_pairs AS VARCHAR) AS rows_or_items FROM filtering_stage_stats_summary WHERE language_pair IS NOT NULL AND num_pairs IS NOT NULL")
def release_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """One line per stage of the summary, which doesn't grow, with its paths rewritten in the tree."""
    stages = table(spark, sf, STATS).filter("language_pair is not null and num_pairs is not null").collect()
    rows = [{"language_pair": r["language_pair"], "stage": r["stage"], "kind": "stage", "required": True, "release_path": f"/data/release/{r['stage']}", "rows_or_items": r["num_pairs"]} for r in stages]
    return tsv.inventory(spark, tsv.rewrite_tree(rows, {"/data/release": "<ROOT>"}))


@C.add("SELECT 0 AS part, src_text AS value FROM (SELECT coalesce(regexp_replace(src_text, '[\\r\\n]', ' ', 'g'), '') AS src_text FROM stage_00_aligned_pair_manifest) UNION ALL SELECT 2, coalesce(regexp_replace(tgt_text, '[\\r\\n]', ' ', 'g'), '') FROM stage_00_aligned_pair_manifest")
def texts_in_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Two text outputs one after the other; the missing one between them is skipped."""
    root = new_folder(spark, "texts")
    for k, c in ((0, "src_text"), (2, "tgt_text")):
        table(spark, sf, MANIFEST).select(F.coalesce(F.regexp_replace(c, "[\r\n]", " "), F.lit(""))).write.text(f"{root}/{k}")
    return tsv.joined_texts(spark, [f"{root}/{k}" for k in range(3)]).select("part", "value")


# Orders and small text forms ---------------------------------------------------------------------


@C.add("""SELECT id, row_number() OVER (ORDER BY TRY_CAST(id AS BIGINT) NULLS LAST, id, line_no) - 1 AS position FROM (SELECT line_no, CASE WHEN line_no % 3 = 0 THEN sample_id ELSE CAST(line_no AS VARCHAR) END AS id FROM stage_00_aligned_pair_manifest)""")
def mixed_ids_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that are numbers come first, by value, then the others by their text."""
    df = table(spark, sf, MANIFEST).select("line_no", F.when(F.col("line_no") % 3 == 0, F.col("sample_id")).otherwise(F.col("line_no").cast("string")).alias("id"))
    return relational.with_position(df, [*selection.mixed_order(F.col("id")), "line_no"]).select("id", "position")


@C.add("SELECT row_number() OVER (ORDER BY row_id, side, logged_at, segments_json NULLS FIRST, status) - 1 AS position, row_id, side FROM sortformer_audio_progress")
def sides_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return relational.with_position(table(spark, sf, LOG).select("row_id", "side", "logged_at", "segments_json", "status"), ["row_id", "side", "logged_at", "segments_json", "status"]).select("position", "row_id", "side")


@C.add("SELECT src_audio FROM (SELECT DISTINCT src_audio FROM stage_00_aligned_pair_manifest WHERE src_audio IS NOT NULL) ORDER BY src_audio LIMIT 100")
def head_of_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 paths of a sorted cache: a limit after an order is the feature here."""
    return table(spark, sf, MANIFEST).select("src_audio").dropna().distinct().orderBy("src_audio").limit(100)


@C.add(r"SELECT row_id, side, logged_at, replace(replace(error, chr(13), '\r'), chr(10), '\n') AS error FROM sortformer_audio_progress WHERE status = 'error'")
def escaped_errors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, LOG).filter("status = 'error'").select("row_id", "side", "logged_at", X.one_line(F.col("error")).alias("error"))


@C.add("""SELECT o_orderkey, '[' || o_custkey || ',' || o_orderstatus || ']' AS units, CAST(o_custkey AS VARCHAR) AS given, 'score +out=/new/' || o_orderkey || ' n=3' AS command FROM orders""")
def command_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Lists in brackets brought to one form, and a path in a command read and replaced."""
    units = F.concat(F.lit(" [ "), "o_custkey", F.lit(" ,, "), "o_orderstatus", F.lit("] "))
    command = F.concat(F.lit("score +out='"), "o_custkey", F.lit("' n=3"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        X.bracketed(units).alias("units"),
        X.override(command, "out").alias("given"),
        X.with_override(command, "out", F.concat(F.lit("/new/"), "o_orderkey")).alias("command"),
    )


@C.add("""SELECT CASE lower(trim(source_lang)) WHEN 'en' THEN 'english' WHEN 'eng' THEN 'english' WHEN 'es' THEN 'spanish' WHEN 'spa' THEN 'spanish' WHEN 'de' THEN 'german' WHEN 'deu' THEN 'german'
  ELSE lower(trim(source_lang)) END AS language, count(*) AS n FROM evaluation_manifest GROUP BY 1""")
def recogniser_languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, EVAL).groupBy(X.recogniser_language(F.col("source_lang")).alias("language")).agg(F.count("*").alias("n"))


_ENCODED = "('en', 'eng', 'de', 'deu', 'es', 'spa')"


@C.add(f"""SELECT 'sonar_speech_encoder_' || CASE lower(trim(src_lang)) WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE lower(trim(src_lang)) END AS encoder, count(*) AS n
 FROM stage_00_aligned_pair_manifest WHERE lower(trim(src_lang)) IN {_ENCODED} GROUP BY 1""")
def speech_encoders(spark: SparkSession, sf: str) -> DataFrame:
    """Encoders of the rows that have one; any other language would be an error."""
    known = table(spark, sf, MANIFEST).filter(F.lower(X.strip(F.col("src_lang"))).isin(*X.SPEECH_ENCODERS))
    return known.groupBy(X.speech_encoder(F.col("src_lang")).alias("encoder")).agg(F.count("*").alias("n"))


@C.add(r"""SELECT CAST(list_last(m) AS DOUBLE) AS value, count(*) AS n FROM (SELECT regexp_extract_all(regexp_replace(src_text, '[\r\n]', ' ', 'g'), '[-+]?\d+(?:\.\d+)?') AS m FROM stage_00_aligned_pair_manifest WHERE src_text IS NOT NULL) WHERE len(m) > 0 GROUP BY 1""")
def numbers_in_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The last number of each line of a text output."""
    path = new_folder(spark, "lines")
    table(spark, sf, MANIFEST).select(F.regexp_replace("src_text", "[\r\n]", " ").alias("value")).dropna().write.text(path)
    return tsv.read_numbers(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@C.add("SELECT event_id, json_extract_string(props, '$.k') AS flat, json_extract_string(props, '$.k') AS nested FROM events")
def shallow_json(spark: SparkSession, sf: str) -> DataFrame:
    """A key of the top level, and the same key one level down."""
    df = table(spark, sf, "events")
    nested = F.concat(F.lit('{"outer": '), "props", F.lit(', "other": 1}'))
    return df.select("event_id", X.shallow_text(F.col("props"), "k").alias("flat"), X.shallow_text(nested, "k").alias("nested"))


# Resumed runs ---------------------------------------------------------------------------------------

_ORDERED = """SELECT row_id, side, status FROM (SELECT *, row_number() OVER (PARTITION BY row_id, side ORDER BY logged_at DESC, segments_json DESC NULLS LAST, status DESC) AS rn FROM sortformer_audio_progress) WHERE rn = 1"""


@C.add(f"""WITH l AS ({_ORDERED}), w AS (SELECT DISTINCT sample_id AS row_id, side FROM stage_00_aligned_pair_manifest, (VALUES ('source'), ('target')) v(side))
 SELECT 'skip' AS mode, count(*) AS n FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.row_id = w.row_id AND l.side = w.side AND l.status IN ('done', 'error'))
 UNION ALL SELECT 'rerun errors', count(*) FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.row_id = w.row_id AND l.side = w.side AND l.status = 'done') UNION ALL SELECT 'rerun all', count(*) FROM w""")
def pending_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    """What is left to do if errors are skipped, if they are run again, and if that means everything."""
    ids = table(spark, sf, MANIFEST).select(F.col("sample_id").alias("row_id")).distinct()
    work = stage(ids.select("row_id", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side")), "work")
    log = table(spark, sf, LOG).select("row_id", "side", "logged_at", "segments_json", "status")
    modes = {"skip": {}, "rerun errors": {"rerun_errors": True}, "rerun all": {"rerun_all": True}}
    out = None
    for mode, how in modes.items():
        n = incremental.pending(work, log, ["row_id", "side"], ["logged_at", "segments_json", "status"], **how).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@C.add("SELECT line_no FROM stage_00_aligned_pair_manifest WHERE line_no NOT IN (SELECT line_no FROM stage_00_aligned_pair_manifest WHERE src_lang IS NOT NULL)")
def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run that was begun under the same contract, of which the rows with a language are done."""
    folder = new_folder(spark, "run")
    rows = table(spark, sf, MANIFEST).select("line_no", "src_lang")
    wanted = incremental.contract(spark, f"{sf}/{MANIFEST}.parquet", model="m", batch=8)
    incremental.resumed(spark, folder, wanted, rows, ["line_no"])
    rows.filter("src_lang is not null").write.parquet(f"{folder}/done")
    return incremental.resumed(spark, folder, wanted, rows, ["line_no"]).select("line_no")


@C.add("""WITH p AS (SELECT sample_id, max(src_text) AS src_text, max(length(tgt_text)) AS bytes FROM train_metadata WHERE sample_id IS NOT NULL GROUP BY 1)
 SELECT m.line_no, m.sample_id FROM stage_00_aligned_pair_manifest m JOIN p ON p.sample_id = m.sample_id AND p.src_text IS NOT DISTINCT FROM m.src_text WHERE p.bytes > 0""")
def reusable_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose earlier output is there, isn't empty, and was made of the same text."""
    prior = table(spark, sf, TRAIN).filter("sample_id is not null").groupBy("sample_id").agg(F.max("src_text").alias("src_text"), F.max(F.length("tgt_text")).alias("bytes"))
    now = table(spark, sf, MANIFEST).select("line_no", "sample_id", "src_text")
    return incremental.reusable(now, prior, "sample_id", ["src_text"], "bytes").select("line_no", "sample_id")


@C.add("""SELECT show_id, n FROM (SELECT show_id, count(*) AS n FROM stage_00_aligned_pair_manifest WHERE show_id IS NOT NULL GROUP BY 1) WHERE n < 20""")
def shows_without_output(spark: SparkSession, sf: str) -> DataFrame:
    """Shows whose output file isn't there: those of fewer than 20 rows were not written."""
    root = new_folder(spark, "outputs")
    shows = stage(table(spark, sf, MANIFEST).filter("show_id is not null").groupBy("show_id").agg(F.count("*").alias("n")), "shows")
    shows.filter("n >= 20").select("show_id", F.col("n").cast("string")).write.partitionBy("show_id").text(root)
    there = tsv.files_in(spark, root).filter(F.col("path").contains("show_id=")).select(F.regexp_extract("path", "show_id=([^/]+)", 1).alias("path"), "length")
    return incremental.without_output(shows, "show_id", there)


def _shout(texts: list[str]) -> list[str]:
    if any(t is None or '"' in t for t in texts):
        raise ValueError("a text with a quote, or none")
    return [t.upper() for t in texts]


@C.add("""SELECT line_no, CASE WHEN NOT contains(src_text, '"') AND src_text <> '' THEN length(src_text) END AS chars, CASE WHEN NOT contains(src_text, '"') AND src_text <> '' THEN 'done' ELSE 'error' END AS status,
  CASE WHEN src_text IS NULL OR contains(src_text, '"') THEN 'ValueError: a text with a quote, or none' WHEN src_text = '' THEN 'ValueError: empty result' END AS error FROM stage_00_aligned_pair_manifest""")
def isolated_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer that fails on some texts: its lists are scored again text by text, and only those rows are errors."""
    out = incremental.isolated(table(spark, sf, MANIFEST).select("line_no", "src_text"), "src_text", _shout, "shouted")
    return out.select("line_no", F.when(F.col("status") == "done", F.length("src_text")).cast("bigint").alias("chars"), "status", "error")


QUERIES, SQL = C.queries, C.sql
