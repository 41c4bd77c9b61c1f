"""Queries of evaluation: distributions, correlations, compliance, metric joins, nested data, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import expr as X
from corpusloom.operators import relational, selection, statistics
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources import tsv
from corpusloom.staging import new_folder, table
from corpusloom.streaming import progress

C = Catalogue()
MANIFEST, SCORES, EVAL = "stage_00_aligned_pair_manifest", "dnsmospro_quality_pairs", "evaluation_manifest"

_ROUND = 6


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.withColumns({c: F.round(c, _ROUND) for c, t in df.dtypes if t == "double" and c not in keep})


_VALID = "(SELECT substr(sample_id, 1, 5) AS pair, src_dnsmospro AS x, tgt_dnsmospro AS y, combined_dnsmospro AS z, sample_id FROM dnsmospro_quality_pairs)"
_NUM = "CASE WHEN NOT isnan({0}) THEN {0} END"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, SCORES)
    return df.select(F.substring("sample_id", 1, 5).alias("pair"), X.no_nan(F.col("src_dnsmospro")).alias("x"), X.no_nan(F.col("tgt_dnsmospro")).alias("y"), X.no_nan(F.col("combined_dnsmospro")).alias("z"), "sample_id")


# Distributions and intervals -----------------------------------------------------------------


@C.add(f"""WITH s AS (SELECT pair, {_NUM.format('z')} AS v FROM {_VALID})
 SELECT pair, count(v) AS s_n, round(avg(v), 6) AS s_mean, round(quantile_cont(v, 0.5), 6) AS s_median, round(coalesce(stddev_samp(v), 0), 6) AS s_std, round(min(v), 6) AS s_min, round(max(v), 6) AS s_max,
  round(quantile_cont(v, 0.1), 6) AS s_p10, round(quantile_cont(v, 0.25), 6) AS s_p25, round(quantile_cont(v, 0.75), 6) AS s_p75, round(quantile_cont(v, 0.9), 6) AS s_p90 FROM s GROUP BY pair HAVING count(v) > 0""")
def distribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = statistics.distribution(_scores(spark, sf), "z", "s", ["pair"])
    return _rounded(out.drop("s_sem", "s_ci95_half_width", "s_ci95_low", "s_ci95_high"))


@C.add(f"""WITH s AS (SELECT pair, {_NUM.format('z')} AS v FROM {_VALID})
 SELECT pair, round(CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) WHEN count(v) = 1 THEN 0 END, 6) AS sem, round(CASE WHEN count(v) > 1 THEN 1.96 * stddev_samp(v) / sqrt(count(v)) END, 6) AS ci95, round(stddev_pop(v), 6) AS std_population FROM s GROUP BY pair""")
def error_margins(spark: SparkSession, sf: str) -> DataFrame:
    z = F.col("z")
    return _rounded(_scores(spark, sf).groupBy("pair").agg(statistics.sem(z).alias("sem"), statistics.normal_margin(z).alias("ci95"), F.stddev_pop(z).alias("std_population")))


@C.add(f"""WITH s AS (SELECT pair, {_NUM.format('x')} AS x, {_NUM.format('y')} AS y FROM {_VALID}), p AS (SELECT * FROM s WHERE x IS NOT NULL AND y IS NOT NULL),
 r AS (SELECT pair, x, y, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS ry FROM p)
 SELECT pair, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS pearson, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS spearman FROM r GROUP BY pair""")
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.spearman(_scores(spark, sf), "x", "y", ["pair"]))


@C.add(f"""WITH s AS (SELECT pair, {_NUM.format('x')} AS x, {_NUM.format('y')} AS y FROM {_VALID})
 SELECT pair, count(y - x) AS n, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(avg(y - x), 6) AS mean_signed_diff,
  round(avg(CASE WHEN x > 0 AND y > 0 THEN abs(ln(y / x)) END), 6) AS mean_abs_log_ratio FROM s GROUP BY pair""")
def rate_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_scores(spark, sf).groupBy("pair").agg(*statistics.errors(F.col("x"), F.col("y"))))


@C.add(f"""WITH s AS (SELECT pair, {_NUM.format('z')} AS v, {_NUM.format('x')} AS w FROM {_VALID})
 SELECT pair, round(sum(CASE WHEN v IS NOT NULL AND w > 0 THEN v * w END) / nullif(sum(CASE WHEN v IS NOT NULL AND w > 0 THEN w END), 0), 6) AS weighted FROM s GROUP BY pair""")
def weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_scores(spark, sf).groupBy("pair").agg(statistics.weighted_mean(F.col("z"), F.col("x")).alias("weighted")))


_COMPLIANCE = f"(SELECT pair, sample_id, CASE WHEN x > 0 AND y > 0 AND NOT isnan(x) AND NOT isnan(y) THEN least(x, y) / greatest(x, y) END AS c FROM {_VALID})"


@C.add(f"SELECT DISTINCT sample_id, round(c, 6) AS score, CASE WHEN c >= 0.8 THEN 1.0::DOUBLE WHEN c < 0.8 THEN 0.0::DOUBLE END AS within_20, CASE WHEN c >= 0.6 THEN 1.0::DOUBLE WHEN c < 0.6 THEN 0.0::DOUBLE END AS within_40 FROM {_COMPLIANCE}")
def compliance_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c")
    flag = lambda limit: F.when(c >= limit, 1.0).when(c < limit, 0.0)
    df = _scores(spark, sf).select("sample_id", X.compliance(F.col("x"), F.col("y")).alias("c"))
    return df.select("sample_id", F.round(c, 6).alias("score"), flag(0.8).alias("within_20"), flag(0.6).alias("within_40")).distinct()


@C.add(f"SELECT pair, round(avg(CASE WHEN c >= 0.8 THEN 1.0::DOUBLE WHEN c < 0.8 THEN 0.0::DOUBLE END), 6) AS share_20, round(avg(CASE WHEN c >= 0.6 THEN 1.0::DOUBLE WHEN c < 0.6 THEN 0.0::DOUBLE END), 6) AS share_40 FROM {_COMPLIANCE} GROUP BY pair")
def compliance_rates(spark: SparkSession, sf: str) -> DataFrame:
    df = _scores(spark, sf).select("pair", X.compliance(F.col("x"), F.col("y")).alias("c"))
    return _rounded(df.groupBy("pair").agg(statistics.share_at_least(F.col("c"), 0.8).alias("share_20"), statistics.share_at_least(F.col("c"), 0.6).alias("share_40")))


@C.add(f"SELECT DISTINCT sample_id, round((x + y) / 2, 6) AS mean_score, CASE WHEN NOT isnan(x) AND NOT isnan(y) THEN least(x, y) END AS min_score FROM {_VALID} WHERE coalesce(NOT isnan(x), true) AND coalesce(NOT isnan(y), true)")
def combined_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, SCORES).filter(~F.coalesce(F.isnan("src_dnsmospro"), F.lit(False)) & ~F.coalesce(F.isnan("tgt_dnsmospro"), F.lit(False)))
    x, y = F.col("src_dnsmospro"), F.col("tgt_dnsmospro")
    return df.select("sample_id", F.round(X.combine(x, y, "mean"), 6).alias("mean_score"), X.combine(x, y, "min").alias("min_score")).distinct()


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS x FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@C.add(f"SELECT metric, count(x) AS n, round(avg(x), 6) AS mean, round(CASE WHEN count(x) > 1 THEN 1.96 * stddev_samp(x) / sqrt(count(x)) END, 6) AS pm FROM ({_LONG}) GROUP BY metric")
def every_column_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.column_means(table(spark, sf, "lineitem"), "l_linenumber", "ci95"))


# Metric tables ---------------------------------------------------------------------------------

_METRICS = """WITH b AS (SELECT DISTINCT sample_id FROM evaluation_manifest),
 t AS (SELECT DISTINCT sample_id, length(source_text) AS chars FROM evaluation_manifest), h AS (SELECT sample_id, max(length(hypo_text)) AS chars, max(status) AS status FROM evaluation_manifest GROUP BY 1)
"""


@C.add(_METRICS + "SELECT b.sample_id, t.chars, h.chars AS hypothesis_chars, h.status FROM b LEFT JOIN t USING (sample_id) LEFT JOIN h USING (sample_id)")
def metric_left_join(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, EVAL)
    source = df.select("sample_id", F.length("source_text").cast("bigint").alias("chars")).distinct()
    hypo = df.groupBy("sample_id").agg(F.max(F.length("hypo_text").cast("bigint")).alias("chars"), F.max("status").alias("status"))
    return relational.join_metrics(df.select("sample_id").distinct(), {"source": source, "hypothesis": hypo})


@C.add("""WITH e AS (SELECT *, upper(status) LIKE '%FAIL%' AS bad FROM evaluation_manifest)
 SELECT source_lang, count(*) AS raw, count(*) FILTER (status = 'ok') AS kept, count(*) FILTER (bad) AS failed, count(*) FILTER (hypo_text IS NULL) AS without_hypothesis, count(*) FILTER (reference_text IS NULL) AS without_reference FROM e GROUP BY 1""")
def filter_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, EVAL)
        .groupBy("source_lang")
        .agg(
            F.count("*").alias("raw"),
            F.count_if(F.col("status") == "ok").alias("kept"),
            F.count_if(relational.failed(F.col("status"))).alias("failed"),
            F.count_if(F.col("hypo_text").isNull()).alias("without_hypothesis"),
            F.count_if(F.col("reference_text").isNull()).alias("without_reference"),
        )
    )


@C.add("""SELECT CASE lower(trim(source_lang)) WHEN 'en' THEN 'eng_Latn' WHEN 'eng' THEN 'eng_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'deu' THEN 'deu_Latn' WHEN 'es' THEN 'spa_Latn' WHEN 'spa' THEN 'spa_Latn' ELSE trim(source_lang) END AS tag, count(*) AS n
 FROM evaluation_manifest GROUP BY 1""")
def text_languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, EVAL).groupBy(X.text_language(F.col("source_lang")).alias("tag")).agg(F.count("*").alias("n"))


# Text and JSON -----------------------------------------------------------------------------------


@C.add(r"SELECT line_no, trim(regexp_replace(src_text, '[\s\pZ\x{0B}\x{85}]+', ' ', 'g')) AS cleaned FROM stage_00_aligned_pair_manifest")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, MANIFEST).select("line_no", X.clean_text(F.col("src_text")).alias("cleaned"))


@C.add("SELECT line_no, replace(replace(src_audio, '/data/dubs/en_es', '<EN_ES>'), '/data/dubs', '<ROOT>') AS released FROM stage_00_aligned_pair_manifest")
def sanitize_paths(spark: SparkSession, sf: str) -> DataFrame:
    df = tsv.rewrite_text(table(spark, sf, MANIFEST).select("line_no", F.col("src_audio").alias("released")), ["released"], {"/data/dubs": "<ROOT>", "/data/dubs/en_es": "<EN_ES>"})
    return df


@C.add("SELECT count(*) FILTER (contains(sample_id, '_')) AS affected, count(DISTINCT replace(sample_id, '_', ' ')) AS ids FROM stage_00_aligned_pair_manifest")
def underscores_to_spaces(spark: SparkSession, sf: str) -> DataFrame:
    spaced = F.replace(F.col("sample_id"), F.lit("_"), F.lit(" "))
    return table(spark, sf, MANIFEST).agg(F.count_if(F.contains("sample_id", F.lit("_"))).alias("affected"), F.count_distinct(spaced).alias("ids"))


@C.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score FROM events")
def json_score_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", X.to_number(X.nested_text(F.col("props"), "k")).alias("score"))


@C.add(r"SELECT event_id, CAST(nullif(regexp_extract(props, ':\s*(\d+)', 1), '') AS DOUBLE) AS score FROM events")
def regex_score_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", X.to_number(X.captured(F.col("props"), r":\s*(\d+)", True)).alias("score"))


@C.add(r"SELECT line_no, CAST(list_last(regexp_extract_all(src_text, '[-+]?\d+(?:\.\d+)?')) AS DOUBLE) AS last_number FROM stage_00_aligned_pair_manifest")
def last_number(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("src_text", F.lit(X.LAST_NUMBER), F.lit(0))
    return table(spark, sf, MANIFEST).select("line_no", F.when(F.size(found) > 0, F.element_at(found, -1)).cast("double").alias("last_number"))


@C.add(r"""SELECT line_no, regexp_replace(regexp_extract(src_audio, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM stage_00_aligned_pair_manifest""")
def path_stems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, MANIFEST).select("line_no", X.stem(F.col("src_audio")).alias("stem"))


@C.add("""SELECT event_id, coalesce(json_extract_string(props, '$.k') IS NOT NULL AND trim(event_type) <> '', false) AS valid FROM events""")
def utterance_validity(spark: SparkSession, sf: str) -> DataFrame:
    annotation = F.to_json(F.struct(X.nested_text(F.col("props"), "k").alias("text"), F.array("event_type").alias("words")))
    return table(spark, sf, "events").select("event_id", X.utterance_is_valid(annotation).alias("valid"))


# Arrays, codes, vectors ------------------------------------------------------------------------------

_TOK = r"(SELECT line_no, regexp_extract_all(lower(src_text), '[\pL\pN]+') AS w FROM stage_00_aligned_pair_manifest WHERE src_text IS NOT NULL)"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, MANIFEST).filter("src_text is not null")
    return df.select("line_no", F.regexp_extract_all(F.lower("src_text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))


@C.add(f"""WITH g AS (SELECT line_no, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM {_TOK}), c AS (SELECT line_no, g, count(*) AS n FROM g GROUP BY ALL)
 SELECT t.line_no, coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS repeated FROM {_TOK} t LEFT JOIN c ON c.line_no = t.line_no GROUP BY t.line_no""")
def repeated_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("line_no", X.repeated_ngram_count(F.col("w"), 2).cast("bigint").alias("repeated"))


@C.add(f"SELECT line_no, array_to_string([x FOR x, i IN w IF list_position(w, x) = i], ' ') AS words FROM {_TOK}")
def unique_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("line_no", F.array_join(F.array_distinct("w"), " ").alias("words"))


@C.add(f"SELECT line_no, len(w) AS frames, CASE WHEN len(w) > 0 THEN len(w[1]) END AS first FROM {_TOK}")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("line_no", F.size("w").cast("bigint").alias("frames"), F.length(F.get("w", F.lit(0))).cast("bigint").alias("first"))


_CODES = "(SELECT l_orderkey, list(CAST(l_partkey % 1024 AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY l_orderkey)"


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    codes = F.transform(parts, lambda p: (p["l_partkey"] % 1024).cast("int"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(codes.alias("c"))


@C.add(f"SELECT l_orderkey, array_to_string(c || c, ' ') AS codes, len(c) AS frames, c[1] AS first, list_sum(c)::BIGINT AS level_sum FROM {_CODES}")
def code_stack_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Two equal levels written flat with a shape, parsed back and checked by their first level."""
    df = _codes(spark, sf).select("l_orderkey", X.code_text(F.concat("c", "c")).alias("codes"), F.concat(F.lit("1x2x"), F.size("c").cast("string")).alias("shape"))
    level = F.get(X.code_stack(F.col("codes"), F.col("shape")), F.lit(1))
    return df.select("l_orderkey", "codes", F.size(level).cast("bigint").alias("frames"), F.get(level, F.lit(0)).alias("first"), F.aggregate(level, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("level_sum"))


@C.add(f"SELECT l_orderkey, array_to_string([1] || c || [2] || [0 FOR i IN range(22 - len(c))], ' ') AS padded, len(c) + 2 AS used FROM {_CODES}")
def wrapped_and_padded(spark: SparkSession, sf: str) -> DataFrame:
    whole = X.wrapped(F.col("c"), 1, 2)
    padded = X.padded(whole, F.lit(24), 0)
    used = F.size(F.filter(X.pad_mask(whole, F.lit(24)), lambda m: m))
    return _codes(spark, sf).select("l_orderkey", X.code_text(padded).alias("padded"), used.cast("bigint").alias("used"))


@C.add(f"SELECT l_orderkey, array_to_string(list_reverse_sort(c)[1:3], ' ') AS top, least(greatest(c[1], 100), 900) AS clamped FROM {_CODES}")
def top_codes(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf).select("l_orderkey", X.code_text(X.top_k(F.col("c"), 3)).alias("top"), X.clamp(F.get("c", F.lit(0)), 100, 900).alias("clamped"))


@C.add("""WITH d AS (SELECT label, embedding, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v FROM embeddings)
 SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v::DOUBLE), 6) AS mean, round(sqrt(greatest(var_pop(v::DOUBLE), 1e-12)), 6) AS std FROM d GROUP BY ALL""")
def pooled_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    frames = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return _rounded(statistics.masked_pooling(frames, ["label"], "dim", "v"))


_PARTS = range(4)


@C.add("SELECT vec_id, " + ", ".join(f"round(list_sum(embedding[{16 * k + 1}:{16 * k + 16}])::DOUBLE / 16, 5) AS part_{k}" for k in _PARTS) + " FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def segment_pooling(spark: SparkSession, sf: str) -> DataFrame:
    parts = statistics.segment_means(F.col("embedding").cast("array<double>"), len(_PARTS))
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(F.get(parts, F.lit(k)), 5).alias(f"part_{k}") for k in _PARTS])


@C.add("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings")
    right = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return df.join(right, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@C.add("""SELECT k.o_orderkey, k.vec_id, len(e.embedding) = 64 AS dim_ok, round(e.embedding[1]::DOUBLE, 6) AS first
  FROM (SELECT o_orderkey, o_custkey % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id FROM orders) k LEFT JOIN embeddings e ON e.vec_id = k.vec_id""")
def indexed_vector_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Indices over the whole table of vectors; an index without a vector is an error."""
    embeddings = table(spark, sf, "embeddings")
    size = embeddings.agg((F.max("vec_id") + 1).alias("size"))
    rows = table(spark, sf, "orders").crossJoin(F.broadcast(size)).select("o_orderkey", (F.col("o_custkey") % F.col("size")).alias("vec_id"))
    vectors = embeddings.select("vec_id", F.lit(True).alias("found"), (F.size("embedding") == 64).alias("dim_ok"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))
    missing = F.raise_error(F.concat(F.lit("no vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    return rows.join(vectors, "vec_id", "left").select("o_orderkey", "vec_id", F.when(F.col("found"), F.col("dim_ok")).otherwise(missing).alias("dim_ok"), "first")


# Windows ------------------------------------------------------------------------------------------


@C.add("SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent FROM events")
def recent_token_count(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    return table(spark, sf, "events").select("event_id", F.count(F.when(F.col("event_type") == "click", 1)).over(w).alias("recent"))


@C.add("SELECT o_orderkey, round(o_totalprice / pow(greatest(length(o_orderpriority), 1), 0.6), 4) AS score, least(greatest((o_totalprice - 1000) / 9000, 0), 1) * 0.5 + 0.1 AS ramp FROM orders")
def scores_and_ramps(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(selection.beam_score(price, F.length("o_orderpriority"), 0.6), 4).alias("score"), X.ramp(price, 1000, 10000, 0.1, 0.6).alias("ramp")
    )


@C.add("SELECT o_orderkey, round_even(o_totalprice / 1000, 0) AS rounded, printf('%.6f', o_totalprice) AS text, CAST(greatest(1, floor(o_totalprice / 1000 + 0.999)) AS INTEGER) AS rows_needed FROM orders")
def rounding(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.bround(price / 1000, 0).alias("rounded"), F.format_string("%.6f", price).alias("text"), X.target_rows(price / 1000).alias("rows_needed"))


# Sources and sinks -----------------------------------------------------------------------------------


_MANIFEST_COLUMNS = ["line_no", "sample_id", "src_audio", "tgt_audio", "src_text", "tgt_text", "src_lang", "tgt_lang", "show_id", "ingested_at"]


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole manifest as text, otherwise unchanged."""
    return table(spark, sf, MANIFEST).select(*[F.col(c).cast("string").alias(c) for c in _MANIFEST_COLUMNS])


def _written(spark: SparkSession, sf: str, compression: str = "none") -> str:
    path = new_folder(spark, "tsv")
    tsv.write_tsv(_texts(spark, sf), path, compression=compression)
    return path


def _every_column(form: str, columns: list[str] = _MANIFEST_COLUMNS) -> str:
    return ", ".join(f"{form.format(f'CAST({c} AS VARCHAR)')} AS {c}" for c in columns)


_NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"


@C.add(f"SELECT {_every_column("coalesce({0}, '')")} FROM stage_00_aligned_pair_manifest")
def tsv_strings(spark: SparkSession, sf: str) -> DataFrame:
    """The whole manifest written and read again; quoted tabs, line breaks and quotes come back as they were."""
    return tsv.read_tsv(spark, _written(spark, sf, "gzip"), "strings", multiline=True)


@C.add(f"SELECT line_no, {_every_column(f'CASE WHEN {{0}} NOT IN {_NA} THEN {{0}} END', _MANIFEST_COLUMNS[1:])} FROM stage_00_aligned_pair_manifest")
def tsv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    return tsv.read_tsv(spark, _written(spark, sf), "inferred", {"line_no": "bigint"}, multiline=True)


@C.add(f"SELECT {_every_column(f"CASE WHEN {{0}} NOT IN {_NA} THEN {{0}} ELSE '' END")} FROM stage_00_aligned_pair_manifest")
def tsv_filled(spark: SparkSession, sf: str) -> DataFrame:
    return tsv.read_tsv(spark, _written(spark, sf), "filled", multiline=True)


@C.add("SELECT DISTINCT sample_id AS value FROM dnsmospro_quality_pairs WHERE NOT coalesce(selected, false)")
def failed_id_list(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "ids")
    tsv.write_ids(table(spark, sf, SCORES).filter("not coalesce(selected, false)"), "sample_id", path)
    return tsv.read_line_set(spark, path)


@C.add("SELECT sample_id, max(CASE WHEN NOT isnan(src_dnsmospro) THEN src_dnsmospro END) AS score FROM dnsmospro_quality_pairs GROUP BY 1 HAVING score IS NOT NULL")
def score_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "cache")
    tsv.write_tsv(table(spark, sf, SCORES).select("sample_id", F.col("src_dnsmospro").cast("string").alias("score")), path)
    return tsv.read_cache(spark, path, "sample_id", "score", number=True)


_SHARD_COLUMNS = ["sample_id", "line_no", *_MANIFEST_COLUMNS[2:]]


@C.add(f"SELECT {_every_column("coalesce({0}, '')", _SHARD_COLUMNS)} FROM stage_00_aligned_pair_manifest")
def shard_union(spark: SparkSession, sf: str) -> DataFrame:
    df = _texts(spark, sf).select(*_SHARD_COLUMNS)
    root = new_folder(spark, "shards")
    for k in range(3):
        tsv.write_tsv(df.filter(F.col("line_no").cast("bigint") % 3 == k), f"{root}/shard{k:03d}", mode="overwrite")
    return tsv.read_shards(spark, f"{root}/shard*", _SHARD_COLUMNS, multiline=True)


# Streaming ------------------------------------------------------------------------------------------


@C.add("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def streaming_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest event per user and type, folded batch by batch from a stream of files."""
    root = new_folder(spark, "stream")
    stage_in = f"{root}/in"
    table(spark, sf, "events").repartition(4, "event_id").write.parquet(stage_in)
    out = f"{root}/out"
    fold = progress.upsert_latest(out, ["user_id", "event_type"], ["ts", "event_id"])
    query = progress.stream_parquet(spark, stage_in, 2).writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return progress.current_state(spark, out).select("user_id", "event_type", "event_id", "value")


@C.add("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per hour and type from a stream of files, whole after the last batch."""
    root = new_folder(spark, "windows")
    table(spark, sf, "events").repartition(4, "event_id").write.parquet(f"{root}/in")
    counts = progress.status_windows(progress.stream_parquet(spark, f"{root}/in", 2), "ts", "event_type")
    save = lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")
    query = counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


QUERIES, SQL = C.queries, C.sql
