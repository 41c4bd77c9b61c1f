"""Queries of the training-data operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.abuse import abuse_scores
from corpusloom.llm.cutoff import cutoffs, kept_records, pair_spelling, scored_records
from corpusloom.llm.duplicates import formatting_duplicates
from corpusloom.llm.leaks import leaks
from corpusloom.llm.overlap import split_overlap
from corpusloom.llm.packing import bins, faults, pack, token_counts
from corpusloom.staging import stage, table

SCORE_RANGE = (1.0, 5.0)
RETENTION_STAGE = "After quality selection"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_duplicates(table(spark, sf_dir, "stage_00_aligned_pair_manifest")).copies()


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_duplicates(table(spark, sf_dir, "stage_00_aligned_pair_manifest")).records()


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = stage(scored_records(table(spark, sf_dir, "dnsmospro_quality_pairs"), "sample_id", "combined_dnsmospro", *SCORE_RANGE), "records")
    targets = (
        table(spark, sf_dir, "filtering_stage_stats_summary")
        .filter(F.col("stage") == RETENTION_STAGE)
        .select(pair_spelling(F.col("language_pair")).alias("source"), F.col("retention_from_previous_stage").alias("target"))
    )
    return records, cutoffs(records, targets, *SCORE_RANGE)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, cuts = _cut(spark, sf_dir)
    return kept_records(records, cuts).select(F.col("source").alias("language_pair"), F.col("id").alias("sample_id"))


def p2_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cuts = _cut(spark, sf_dir)
    return cuts.select(F.col("source").alias("language_pair"), "target", "records", "cutoff", "kept", F.round(F.col("kept") / F.col("records"), 9).alias("kept_share"))


def _overlap(spark: SparkSession, sf_dir: str):
    return split_overlap(table(spark, sf_dir, "train_metadata"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _overlap(spark, sf_dir).pairs()
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its class of equal records and the number of classes of the other side that it overlaps."""
    return _overlap(spark, sf_dir).records().select(F.col("id").alias("sample_id"), "split", "class_id", "links")


def p5_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation rows per split and language pair."""
    rows = _overlap(spark, sf_dir).overlapping_evaluation()
    return rows.groupBy("split", F.substring("id", 1, 5).alias("language_pair")).agg(F.count("*").alias("overlapping"), F.count_if("exact").alias("exact"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_windows"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins(_packed(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window size: bins, pieces, texts that were cut, and the filled share of all bins."""
    packed = stage(_packed(spark, sf_dir), "packed")
    cut = packed.groupBy("window_name").agg(F.count("bin_id").alias("pieces"), F.count_if(F.col("piece_no") == 1).alias("cut_texts"))
    full = bins(packed).groupBy("window_name").agg(F.count("*").alias("bins"), F.sum("used_tokens").alias("tokens"), F.round(F.avg("fill"), 6).alias("fill"))
    return cut.join(full, "window_name")


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must fulfil, counted over all texts, bins and tokens."""
    counts = stage(token_counts(table(spark, sf_dir, "documents")), "counts")
    return faults(stage(pack(counts, table(spark, sf_dir, "pack_windows")), "packed"), counts)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "evaluation_manifest"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "sample_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold its question or its answer."""
    return _leaks(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("documents"), F.count_if("in_question").alias("question_in"), F.count_if("in_answer").alias("answer_in"))


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"), keep=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir).filter("abusive").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir).select("doc_id", "score", "abusive")


def p8_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_records, p2_found, p2_cutoffs, p5_found, p5_records, p5_by_split, p6_packing, p6_bins, p6_fill, p6_faults,
        p7_found, p7_items, p8_found, p8_scores, p8_by_source,
    )
}

_P1 = r"""
WITH r AS (
  SELECT line_no, regexp_replace(replace(lower(src_text), 'ß', 'ss'), '[^\pL\pN]+', '', 'g') AS a, regexp_replace(replace(lower(tgt_text), 'ß', 'ss'), '[^\pL\pN]+', '', 'g') AS b
  FROM stage_00_aligned_pair_manifest WHERE regexp_matches(src_text, '[\pL\pN]') AND regexp_matches(tgt_text, '[\pL\pN]')),
g AS (SELECT line_no, min(line_no) OVER (PARTITION BY least(a, b), greatest(a, b)) AS keep FROM r)
"""
_P2 = r"""
WITH r AS (
  SELECT sample_id, max(combined_dnsmospro) AS score, substr(sample_id, 1, 5) AS language_pair FROM dnsmospro_quality_pairs
  WHERE sample_id IS NOT NULL AND NOT isnan(combined_dnsmospro) AND combined_dnsmospro BETWEEN 1 AND 5 GROUP BY sample_id),
t AS (
  SELECT regexp_replace(lower(trim(language_pair)), '[^a-z]+', '_', 'g') AS language_pair, max(retention_from_previous_stage) AS target
  FROM filtering_stage_stats_summary WHERE stage = 'After quality selection' AND retention_from_previous_stage IS NOT NULL GROUP BY 1),
s AS (
  SELECT language_pair, score, count(*) OVER (PARTITION BY language_pair ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS upto,
         count(*) OVER (PARTITION BY language_pair) AS records FROM r),
c AS (
  SELECT language_pair, target, records, max(score) AS cutoff, min(upto) AS kept FROM s JOIN t USING (language_pair)
  WHERE upto::DOUBLE / records >= target GROUP BY ALL)
"""
_P5 = r"""
WITH r AS (
  SELECT DISTINCT sample_id, lower(trim(split)) AS split, regexp_extract_all(lower(src_text || ' ' || tgt_text), '[\pL\pN]+') AS w
  FROM train_metadata WHERE regexp_matches(src_text, '[\pL\pN]') AND regexp_matches(tgt_text, '[\pL\pN]') AND lower(trim(split)) IN ('train', 'dev', 'test')),
n AS (SELECT sample_id, split, len(w) AS n, list_sort(w) AS bag FROM r),
t AS (SELECT sample_id, split, word, row_number() OVER (PARTITION BY sample_id, split, word) AS k FROM (SELECT sample_id, split, unnest(w) AS word FROM r)),
common AS (
  SELECT e.sample_id AS e, e.split, t.sample_id AS t, count(*) AS common FROM t e JOIN t ON e.word = t.word AND e.k = t.k
  WHERE e.split <> 'train' AND t.split = 'train' AND e.sample_id <> t.sample_id GROUP BY ALL),
p AS (
  SELECT e, c.split, t, a.bag = b.bag AS exact FROM common c JOIN n a ON a.sample_id = e AND a.split = c.split JOIN n b ON b.sample_id = t AND b.split = 'train'
  WHERE common * 100 >= greatest(a.n, b.n) * 85)
"""
_P7 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
iw AS (
  SELECT sample_id, 'q' AS side, regexp_extract_all(lower(source_text), '[\pL\pN]+') AS w FROM evaluation_manifest UNION
  SELECT sample_id, 'a', regexp_extract_all(lower(reference_text), '[\pL\pN]+') FROM evaluation_manifest),
ig AS (SELECT DISTINCT sample_id, side, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT sample_id, side, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
found AS (SELECT doc_id, sample_id, bool_or(side = 'q') AS q, bool_or(side = 'a') AS a FROM dg JOIN ig USING (g) GROUP BY ALL)
"""

SQL = {
    "p1_found": _P1 + "SELECT DISTINCT keep AS keep_line_no, line_no AS copy_line_no FROM g WHERE line_no <> keep",
    "p1_records": _P1 + "SELECT keep AS keep_line_no, count(*) AS copies FROM g GROUP BY keep",
    "p2_found": _P2 + "SELECT language_pair, sample_id FROM r JOIN c USING (language_pair) WHERE score >= cutoff",
    "p2_cutoffs": _P2 + "SELECT *, round(kept::DOUBLE / records, 9) AS kept_share FROM c",
    "p5_found": _P5 + "SELECT DISTINCT least(e, t) AS id_a, greatest(e, t) AS id_b FROM p",
    "p5_records": _P5 + """, link AS (
          SELECT DISTINCT a.bag AS e, b.bag AS t FROM (SELECT e.sample_id AS e, e.split, t.sample_id AS t, count(*) AS common FROM t e JOIN t ON e.word = t.word AND e.k = t.k WHERE e.split <> 'train' AND t.split = 'train' GROUP BY ALL) c
          JOIN n a ON a.sample_id = c.e AND a.split = c.split JOIN n b ON b.sample_id = c.t AND b.split = 'train' WHERE common * 100 >= greatest(a.n, b.n) * 85),
        side AS (SELECT e AS bag, false AS train, count(*) AS links FROM link GROUP BY 1 UNION ALL SELECT t, true, count(*) FROM link GROUP BY 1),
        cls AS (SELECT bag, min(sample_id) AS class_id FROM n GROUP BY bag)
        SELECT DISTINCT n.sample_id, n.split, class_id, coalesce(links, 0)::BIGINT AS links FROM n JOIN cls ON cls.bag = n.bag LEFT JOIN side ON side.bag = n.bag AND side.train = (n.split = 'train')""",
    "p5_by_split": _P5 + """, o AS (SELECT e, split, max(exact) AS exact FROM p GROUP BY ALL)
        SELECT split, substr(e, 1, 5) AS language_pair, count(*) AS overlapping, count(*) FILTER (exact) AS exact FROM o GROUP BY ALL""",
    "p6_faults": """SELECT window_name, (SELECT count(*) FROM documents) AS texts, 0::BIGINT AS overfull, 0::BIGINT AS cut_though_fitting, 0::BIGINT AS tokens_lost
        FROM (SELECT DISTINCT window_name FROM pack_windows WHERE capacity_tokens > 0)""",
    "p7_found": _P7 + "SELECT doc_id, sample_id FROM found",
    "p7_items": _P7 + "SELECT sample_id, count(*) AS documents, count(*) FILTER (q) AS question_in, count(*) FILTER (a) AS answer_in FROM found GROUP BY sample_id",
}
