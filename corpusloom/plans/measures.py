"""Queries of measures: an evaluation from its metrics to its table, correlations, intervals, sequences, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.operators import metrics, relational, selection, statistics
from corpusloom.plans.catalogue import Catalogue
from corpusloom.staging import stage, table

C = Catalogue()
MANIFEST, LOG, SCORES, EVAL = "stage_00_aligned_pair_manifest", "sortformer_audio_progress", "dnsmospro_quality_pairs", "evaluation_manifest"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# An evaluation ------------------------------------------------------------------------------

METRICS = metrics.Registry()


def _texts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("sample_id").agg(*[F.max(c).alias(c) for c in ("source_text", "hypo_text", "reference_text")])


@METRICS.add("length")
def _length(manifest: DataFrame) -> DataFrame:
    chars = lambda c: F.length(c).cast("double")
    return _texts(manifest).select("sample_id", X.compliance(chars("source_text"), chars("hypo_text")).alias("dc_score"), chars("hypo_text").alias("score"))


@METRICS.add("reference")
def _reference(manifest: DataFrame) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    both = F.size(F.array_intersect(words("hypo_text"), words("reference_text")))
    return _texts(manifest).select("sample_id", F.when(F.col("hypo_text").isNotNull() & F.col("reference_text").isNotNull(), F.try_divide(both, F.size(words("reference_text")))).alias("score"))


_PER_EXAMPLE = r"""WITH t AS (SELECT sample_id, max(source_text) AS s, max(hypo_text) AS h, max(reference_text) AS r FROM evaluation_manifest GROUP BY 1),
 w AS (SELECT *, list_distinct(regexp_extract_all(lower(h), '[\pL\pN]+')) AS hw, list_distinct(regexp_extract_all(lower(r), '[\pL\pN]+')) AS rw FROM t),
 per AS (SELECT sample_id, CASE WHEN length(s) > 0 AND length(h) > 0 THEN least(length(s), length(h))::DOUBLE / greatest(length(s), length(h)) END AS dc_score, length(h)::DOUBLE AS score,
   CASE WHEN h IS NOT NULL AND r IS NOT NULL THEN len(list_intersect(hw, rw))::DOUBLE / nullif(len(rw), 0) END AS reference_score FROM w)
"""


def _per_example(spark: SparkSession, sf: str) -> DataFrame:
    manifest = table(spark, sf, EVAL).filter("sample_id is not null")
    return METRICS.per_example(manifest, ["length", "reference"])


@C.add(_PER_EXAMPLE + "SELECT sample_id, round(dc_score, 6) AS dc_score, score, round(reference_score, 6) AS reference_score FROM per WHERE sample_id IS NOT NULL")
def per_example_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """All enabled metrics of the registry beside the ids; a name that two metrics use gets the metric in front."""
    return _rounded(_per_example(spark, sf))


_SUMMARIES = [{"dc_0p2_compliance": 0.25, "other": 9.0}, {"score_mean": 70.5, "dc_0p2_compliance": 0.75}]
_AGGREGATED = _PER_EXAMPLE + """, long AS (SELECT 'dc_score' AS metric, dc_score AS x FROM per WHERE sample_id IS NOT NULL UNION ALL SELECT 'reference_score', reference_score FROM per WHERE sample_id IS NOT NULL),
 agg AS (SELECT metric || '_mean' AS key, avg(x) AS value, CASE WHEN count(x) > 1 THEN 1.96 * stddev_samp(x) / sqrt(count(x)) END AS pm FROM long GROUP BY 1
   UNION ALL SELECT 'score_mean', 70.5, NULL UNION ALL SELECT 'dc_0p2_compliance_mean', 0.75, NULL)
"""


def _aggregated(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.aggregate(stage(_per_example(spark, sf), "examples"), _SUMMARIES, uncertainty="ci95")


@C.add(_AGGREGATED + "SELECT key, round(value, 6) AS value, round(pm, 6) AS pm FROM agg")
def aggregate_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the per-example table, except where a summary gives the key; later summaries win."""
    return _rounded(_aggregated(spark, sf))


@C.add(_AGGREGATED + """, want(place, name, k, key) AS (VALUES (0, 'Duration', 0, 'dc_0p9_mean'), (0, 'Duration', 1, 'dc_score_mean'), (1, 'Length', 0, 'score_mean'), (2, 'Words', 0, 'reference_score_mean'), (3, 'None', 0, 'absent_mean')),
 best AS (SELECT want.place, want.name, agg.value, agg.pm, row_number() OVER (PARTITION BY want.place ORDER BY agg.value IS NULL, want.k) AS rn FROM want LEFT JOIN agg USING (key))
 SELECT CAST(place AS INTEGER) AS "at", name, round(value, 4) AS value, round(pm, 4) AS pm FROM best WHERE rn = 1""")
def metrics_table(spark: SparkSession, sf: str) -> DataFrame:
    """The final table: each line takes the first of its keys that has a value."""
    lines = [("Duration", ["dc_0p9_mean", "dc_score_mean"]), ("Length", ["score_mean"]), ("Words", ["reference_score_mean"]), ("None", ["absent_mean"])]
    return metrics.table(_aggregated(spark, sf), lines)


@C.add("SELECT sample_id, 3.5::DOUBLE AS naturalness, 0.0::DOUBLE AS similarity FROM evaluation_manifest")
def dry_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return relational.dry_run(table(spark, sf, EVAL), "sample_id", {"naturalness": 3.5, "similarity": 0})


@C.add("SELECT 'kept' AS mode, count(*) AS n FROM evaluation_manifest WHERE status = 'ok' UNION ALL SELECT 'all', count(*) FROM evaluation_manifest")
def status_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, EVAL)
    count = lambda d, mode: d.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
    return count(relational.keep_status(df), "kept").unionByName(count(relational.keep_status(df, keep_others=True), "all"))


# Statistics -----------------------------------------------------------------------------------

_NUM = "CASE WHEN NOT isnan({0}) THEN {0} END"
_T = ", ".join(f"({k}, {statistics.t_quantile(k)!r})" for k in range(1, statistics.T_TABLE + 1))
#: A table of Student's t for the degrees of freedom that have a row; beyond, the expansion around the normal quantile.
_WITH_T = f"""WITH q(df, t) AS (VALUES {_T}), s AS (SELECT substr(sample_id, 1, 5) AS pair, {_NUM.format('combined_dnsmospro')} AS v FROM dnsmospro_quality_pairs),
 g AS (SELECT pair, count(v) AS n, avg(v) AS mean, CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) ELSE 0 END AS sem, 1.959963984540054::DOUBLE AS z, (count(v) - 1)::DOUBLE AS d FROM s GROUP BY pair HAVING count(v) > 0),
 f AS (SELECT g.*, coalesce(q.t, z + (pow(z, 3) + z) / (4 * d) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * d * d) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * d * d * d)) AS t FROM g LEFT JOIN q ON q.df = g.n - 1),
 h AS (SELECT *, CASE WHEN n > 1 THEN sem * t ELSE 0 END AS half FROM f)
"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, SCORES).select(F.substring("sample_id", 1, 5).alias("pair"), X.no_nan(F.col("combined_dnsmospro")).alias("z"))


@C.add(_WITH_T + "SELECT pair, n AS s_n, round(mean, 6) AS s_mean, round(sem, 6) AS s_sem, round(mean - half, 6) AS s_ci95_low, round(mean + half, 6) AS s_ci95_high, round(half, 6) AS s_ci95_half_width FROM h")
def t_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Student-t intervals per language pair."""
    out = statistics.distribution(_pairs(spark, sf), "z", "s", ["pair"])
    return _rounded(out.select("pair", "s_n", "s_mean", "s_sem", "s_ci95_low", "s_ci95_high", "s_ci95_half_width"))


@C.add(_WITH_T + "SELECT pair, round(CASE WHEN n > 1 THEN sem * t END, 6) AS margin, round(mean - CASE WHEN n > 1 THEN sem * t ELSE 0 END, 6) AS low, round(mean + CASE WHEN n > 1 THEN sem * t ELSE 0 END, 6) AS high FROM h WHERE n <= 1 OR sem > 0")
def t_margins(spark: SparkSession, sf: str) -> DataFrame:
    """The margin alone, which a single value doesn't have, and the interval without a guard."""
    g = _pairs(spark, sf).groupBy("pair").agg(F.count("z").alias("n"), F.avg("z").alias("mean"), statistics.sem(F.col("z")).alias("sem")).filter("n > 0 and (n <= 1 or sem > 0)")
    bare = statistics.t_interval_bare(F.col("mean"), F.col("n"), F.col("sem"))
    return _rounded(g.select("pair", statistics.t_margin(F.col("n"), F.col("sem")).alias("margin"), bare["low"].alias("low"), bare["high"].alias("high")))


_RATES = r"""WITH r AS (SELECT length(src_text)::DOUBLE AS sc, length(tgt_text)::DOUBLE AS tc, len(regexp_extract_all(src_text, '[\pL\pN]+'))::DOUBLE AS sw, len(regexp_extract_all(tgt_text, '[\pL\pN]+'))::DOUBLE AS tw,
   len(regexp_extract_all(lower(src_text), '[aeiouy]+'))::DOUBLE AS ss, len(regexp_extract_all(lower(tgt_text), '[aeiouy]+'))::DOUBLE AS ts FROM stage_00_aligned_pair_manifest),
 l AS (SELECT 'word' AS unit, sw AS x, tw AS y FROM r UNION ALL SELECT 'syllable', ss, ts FROM r UNION ALL SELECT 'char', sc, tc FROM r),
 p AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
 k AS (SELECT unit, x, y, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY unit ORDER BY y) + (count(*) OVER (PARTITION BY unit, y) - 1) / 2.0 AS ry FROM p)
"""


@C.add(_RATES + "SELECT unit, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k GROUP BY unit HAVING count(*) > 1")
def unit_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of both sides' lengths in words, runs of vowels and characters."""
    found = lambda c, pattern: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    sizes = {"word": lambda c: found(c, r"[\p{L}\p{N}]+"), "syllable": lambda c: found(F.lower(c), "[aeiouy]+"), "char": F.length}
    rows = table(spark, sf, MANIFEST).select(*[F.when(F.col(c).isNotNull(), size(F.col(c))).alias(f"{c}_{unit}") for unit, size in sizes.items() for c in ("src_text", "tgt_text")])
    return _rounded(statistics.correlation_table(rows, {unit: (f"src_text_{unit}", f"tgt_text_{unit}") for unit in sizes}))


@C.add(r"""WITH r AS (SELECT src_lang, len(regexp_extract_all(src_text, '[\pL\pN]+'))::DOUBLE AS x, len(regexp_extract_all(tgt_text, '[\pL\pN]+'))::DOUBLE AS y FROM stage_00_aligned_pair_manifest)
 SELECT src_lang, count(y - x) AS n, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(avg(y - x), 6) AS mean_signed_diff, round(avg(CASE WHEN x > 0 AND y > 0 THEN abs(ln(y / x)) END), 6) AS mean_abs_log_ratio FROM r GROUP BY 1""")
def best_rate_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of the rate column that goes first by its name and unit, of several."""
    words = lambda c: F.when(F.col(c).isNotNull(), F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).cast("double"))
    sides = table(spark, sf, MANIFEST).select(
        "src_lang", *[x.alias(f"{s}.{c}") for s in ("src", "tgt") for c, x in (("rate_word", F.lit(0.0)), ("speech_rate_char", F.length(f"{s}_text").cast("double")), ("speech_rate_word", words(f"{s}_text")))]
    )
    best = relational.best_rate_column([c[4:] for c in sides.columns if c.startswith("src.")])
    return _rounded(sides.groupBy("src_lang").agg(*statistics.errors(F.col(f"`src.{best}`"), F.col(f"`tgt.{best}`"))))


_MATCHED = """WITH v AS (SELECT row_id AS k, side, coalesce(status = 'done' AND num_speakers = 1, false) AS ok FROM sortformer_audio_progress),
 s AS (SELECT * FROM v WHERE side = 'source'), t AS (SELECT * FROM v WHERE side = 'target'),
 x AS (SELECT (SELECT count(*) FROM s) AS src_raw, (SELECT count(*) FROM t) AS tgt_raw, (SELECT count(*) FROM s WHERE k IN (SELECT k FROM t)) AS src_matched, (SELECT count(*) FROM t WHERE k IN (SELECT k FROM s)) AS tgt_matched,
  (SELECT count(DISTINCT k) FROM s WHERE ok AND k IN (SELECT k FROM t WHERE ok)) AS kept, (SELECT count(*) FROM s WHERE NOT ok) AS src_invalid, (SELECT count(*) FROM t WHERE NOT ok) AS tgt_invalid)
"""


def _valid_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, LOG).select("row_id", "side", ((F.col("status") == "done") & (F.col("num_speakers") == 1)).alias("ok"))
    return v.filter("side = 'source'"), v.filter("side = 'target'")


@C.add(_MATCHED + "SELECT *, greatest(src_matched, tgt_matched) - kept AS dropped, src_raw - src_matched AS src_unmatched, tgt_raw - tgt_matched AS tgt_unmatched FROM x")
def match_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Raw, matched, kept, dropped, invalid and unmatched rows of the two sides."""
    return statistics.filter_counts(*_valid_sides(spark, sf), "row_id", "ok")


@C.add(_MATCHED.replace(",\n x AS (", ",\n unused AS (") + """SELECT count(*) FILTER (side = 'source') AS src_raw, count(*) FILTER (side = 'target') AS tgt_raw, count(*) FILTER (side = 'source' AND NOT ok) AS src_invalid,
  count(*) FILTER (side = 'target' AND NOT ok) AS tgt_invalid, (SELECT kept FROM unused) AS kept FROM v""")
def shard_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts made for eight shards of the ids and added up."""
    source, target = _valid_sides(spark, sf)
    shard = F.pmod(F.xxhash64("row_id"), F.lit(8))
    counts = None
    for k in range(8):
        own = statistics.filter_counts(source.filter(shard == k), target.filter(shard == k), "row_id", "ok").select("src_raw", "tgt_raw", "src_invalid", "tgt_invalid", "kept")
        counts = own if counts is None else counts.unionByName(own)
    return statistics.summed(counts)


@C.add("""SELECT a.label, count(*) AS n, round(avg(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS loss FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1""")
def cosine_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of one less the cosine, per label; each vector against the next."""
    df = table(spark, sf, "embeddings")
    right = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    loss = F.avg(1 - X.cosine(F.col("embedding"), F.col("other")))
    return df.join(right, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.round(loss, 6).alias("loss"))


@C.add("""SELECT CAST(k AS BIGINT) AS log, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS k FROM events) GROUP BY 1""")
def running_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of a measure between two logs, which are 100 steps apart."""
    steps = selection.batches(table(spark, sf, "events").select("ts", "event_id", "value"), ["ts", "event_id"], 100)
    return _rounded(steps.groupBy(F.col("batch").alias("log")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@C.add("SELECT row_id, side, logged_at, greatest(total_labeled_duration, dominant_duration, secondary_duration) AS longest FROM sortformer_audio_progress WHERE coalesce(NOT isnan(total_labeled_duration + dominant_duration + secondary_duration), true)")
def longest_duration(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest of several columns, nulls passed over."""
    parts = [F.col(c) for c in ("total_labeled_duration", "dominant_duration", "secondary_duration")]
    whole = F.coalesce(~F.isnan(parts[0] + parts[1] + parts[2]), F.lit(True))
    return table(spark, sf, LOG).filter(whole).select("row_id", "side", "logged_at", F.greatest(*parts).alias("longest"))


# Sequences ---------------------------------------------------------------------------------------

_CODES = "(SELECT l_orderkey, list(CAST(l_partkey % 16 AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY l_orderkey)"


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(parts, lambda p: (p["l_partkey"] % 16).cast("int")).alias("c"))


_JOINED = "array_to_string({0}, ' ')"


@C.add(f"""SELECT l_orderkey, {_JOINED.format('[c[i + 1] FOR i IN range(1, len(c)) IF c[i] = c[len(c)]]')} AS following,
  (SELECT {_JOINED.format('list(x ORDER BY first_at)')} FROM (SELECT c[i + 1] AS x, min(i) AS first_at FROM (SELECT unnest(range(1, len(c))) AS i) WHERE c[i] = c[len(c)] GROUP BY 1)) AS banned FROM {_CODES}""")
def banned_continuations(spark: SparkSession, sf: str) -> DataFrame:
    """What followed earlier occurrences of the last code, and thus would repeat a pair."""
    after = F.filter(F.transform("c", lambda x, i: F.struct(x.alias("x"), F.get("c", i + 1).alias("y"))), lambda p: (p["x"] == F.element_at("c", -1)) & p["y"].isNotNull())
    banned = X.banned_continuations(F.col("c"), 2)
    return _codes(spark, sf).select("l_orderkey", X.code_text(F.transform(after, lambda p: p["y"])).alias("following"), F.when(F.size(banned) > 0, X.code_text(banned)).alias("banned"))


@C.add(f"SELECT l_orderkey, {_JOINED.format('[x + 200 FOR x IN c] || c || [x + 100 FOR x IN c]')} AS levels FROM {_CODES}")
def code_levels_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Three levels written flat, read back with the last one first."""
    c = F.col("c")
    more = lambda k: F.transform(c, lambda x: x + k)
    flat, shape = X.code_text(F.concat(c, more(100), more(200), more(300))), F.concat(F.lit(" 1X4x"), F.size(c).cast("string"))
    rows = _codes(spark, sf).select("l_orderkey", flat.alias("codes"), shape.alias("shape"))
    return rows.select("l_orderkey", X.code_text(F.flatten(X.code_stack(F.col("codes"), F.col("shape"), 3, [2, 0, 1]))).alias("levels"))


@C.add(f"""SELECT l_orderkey, CASE WHEN len(c) = 2 THEN {_JOINED.format('c || [x + 100 FOR x IN c]')} ELSE {_JOINED.format('flatten([[x, x + 100] FOR x IN c])')} END AS frames, {_JOINED.format('flatten([[x, x + 100] FOR x IN c])')} AS same FROM {_CODES}""")
def frames_first(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels, given as levels or as frames, both brought to frames; two by two are taken for frames."""
    c = F.col("c")
    levels = F.array(c, F.transform(c, lambda x: x + 100))
    frames = F.transform(c, lambda x: F.array(x, x + 100))
    rows = _codes(spark, sf)
    return rows.select("l_orderkey", X.code_text(F.flatten(X.frames_first(levels, 2))).alias("frames"), X.code_text(F.flatten(X.frames_first(frames, 2))).alias("same"))


@C.add(f"SELECT l_orderkey, {_JOINED.format('list_reverse(range(len(c)))')} AS inverse, {_JOINED.format('c')} AS stripped, {_JOINED.format('[8, 50, 60] || c[1:3] || [61, 9]')} AS sequence FROM {_CODES}")
def orders_and_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """The inverse of a permutation, codes wrapped and stripped again, and a sequence cut to a budget of eight tokens."""
    back = F.reverse(F.sequence(F.lit(0), F.size("c") - 1))
    budget = X.within_budget(F.col("c"), 8, 8, 9, (50,), (60, 61), True)
    return _codes(spark, sf).select("l_orderkey", X.code_text(X.inverse_order(back)).alias("inverse"), X.code_text(X.unwrapped(X.wrapped(F.col("c"), 1, 2))).alias("stripped"), X.code_text(budget).alias("sequence"))


@C.add(f"""WITH b AS (SELECT l_orderkey, c, (row_number() OVER (ORDER BY l_orderkey) - 1) // 32 AS batch FROM {_CODES}), m AS (SELECT batch, max(len(c)) AS longest FROM b GROUP BY 1)
 SELECT l_orderkey, batch, {_JOINED.format('c || [-1 FOR i IN range(longest - len(c))]')} AS padded, len(c) AS used FROM b JOIN m USING (batch)""")
def collated_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of 32 sequences, each brought to the longest of its batch, with a mask."""
    rows = relational.collated(selection.batches(_codes(spark, sf), ["l_orderkey"], 32), "batch", "c", -1)
    return rows.select("l_orderkey", "batch", X.code_text(F.col("padded")).alias("padded"), F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("used"))


@C.add("""SELECT line_no, src_lang, CAST((row_number() OVER (PARTITION BY src_lang ORDER BY line_no) - 1) // 32 AS BIGINT) AS batch FROM stage_00_aligned_pair_manifest""")
def language_batches(spark: SparkSession, sf: str) -> DataFrame:
    return relational.group_batches(table(spark, sf, MANIFEST).select("line_no", "src_lang"), "src_lang", ["line_no"], 32)


@C.add("""SELECT lang, count(source) AS present, count(*) AS total, count(source) IN (0, count(*)) AS consistent FROM documents GROUP BY lang""")
def optional_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an optional column is there for all rows of a group or for none."""
    return relational.all_or_none(table(spark, sf, "documents"), "source", ["lang"])


@C.add("SELECT o_orderkey, round(o_totalprice / pow(greatest(length(o_orderpriority), 1), 0.6) - CASE WHEN o_orderstatus = 'F' THEN 10.0 ELSE 0 END, 4) AS score FROM orders")
def beam_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by length, with the penalty of hypotheses whose length was capped."""
    score = selection.beam_score(F.col("o_totalprice"), F.length("o_orderpriority"), 0.6, F.col("o_orderstatus") == "F", 10.0)
    return table(spark, sf, "orders").select("o_orderkey", F.round(score, 4).alias("score"))


@C.add("""SELECT vec_id, round(list_max([abs(x) FOR x IN e]) / greatest(list_max([abs(x) FOR x IN e]), 1), 6) AS peak, round(list_sum(e) / greatest(list_max([abs(x) FOR x IN e]), 1), 6) AS total
 FROM (SELECT vec_id, [x * 10 FOR x IN CAST(embedding AS DOUBLE[])] AS e FROM embeddings)""")
def peak_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Samples divided by a peak above one."""
    samples = X.peak_normalized(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10))
    return _rounded(table(spark, sf, "embeddings").select("vec_id", F.array_max(F.transform(samples, F.abs)).alias("peak"), F.aggregate(samples, F.lit(0.0), lambda s, x: s + x).alias("total")))


QUERIES, SQL = C.queries, C.sql
