import math

import pytest
from corpusloom.operators import diarization, statistics
from pyspark.sql import functions as F


def test_t_quantiles():
    # Two-sided 95 % points from published tables.
    for df, want in {1: 12.706205, 2: 4.302653, 5: 2.570582, 10: 2.228139, 30: 2.042272, 120: 1.979930}.items():
        assert abs(statistics.t_quantile(df) - want) < 1e-5


def test_t_factor_series_meets_the_table(spark):
    got = [r[0] for r in spark.createDataFrame([(2,), (11,), (201,), (202,), (5001,)], "n int").select(statistics.t_factor(F.col("n"))).collect()]
    for n, value in zip((2, 11, 201, 202, 5001), got):
        assert abs(value - statistics.t_quantile(n - 1)) < 1e-7


def test_distribution_conventions(spark):
    rows = [("one", "3"), ("flat", "2"), ("flat", "2"), ("some", "1"), ("some", "2"), ("some", "4"), ("some", "nan"), ("some", None), ("some", "x"), ("none", "x")]
    got = {r["g"]: r for r in statistics.distribution(spark.createDataFrame(rows, "g string, v string"), "v", "x", ["g"]).collect()}
    assert set(got) == {"one", "flat", "some"}
    assert got["one"]["x_std"] == 0 and got["one"]["x_sem"] == 0 and got["one"]["x_ci95_low"] == 3
    assert got["flat"]["x_ci95_half_width"] == 0
    s = got["some"]
    sem = math.sqrt(((1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2) / 2 / 3)
    assert s["x_n"] == 3 and abs(s["x_sem"] - sem) < 1e-12 and abs(s["x_ci95_half_width"] - 4.302652729911275 * sem) < 1e-9
    assert abs(s["x_p10"] - 1.2) < 1e-12 and abs(s["x_p90"] - 3.6) < 1e-12


def test_margins(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    x, n = F.col("x"), F.count("x")
    got = {r["g"]: r for r in df.groupBy("g").agg(statistics.normal_margin(x).alias("normal"), statistics.t_margin(n, statistics.sem(x)).alias("t"), statistics.t_interval_bare(F.avg("x"), n, statistics.sem(x)).alias("bare")).collect()}
    assert got["a"]["normal"] is None and got["a"]["t"] is None and got["a"]["bare"]["low"] == 1
    assert abs(got["b"]["normal"] - 1.96) < 1e-9 and abs(got["b"]["t"] - 12.706204736) < 1e-6


def test_correlation_guards(spark):
    rows = [("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("one", 1.0, 1.0), ("up", 1.0, 1.0), ("up", 2.0, 4.0), ("up", 3.0, 9.0), ("up", None, 9.0), ("tie", 1.0, 2.0), ("tie", 1.0, 1.0), ("tie", 2.0, 3.0)]
    got = {r["g"]: r for r in statistics.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert got["flat"]["pearson"] is None and got["flat"]["spearman"] is None and got["one"]["pearson"] is None
    assert abs(got["up"]["spearman"] - 1) < 1e-12 and got["up"]["n"] == 3
    assert abs(got["tie"]["spearman"] - 0.8660254037844387) < 1e-12


def test_weighted_and_shares(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (9.0, 0.0), (9.0, -1.0), (None, 5.0)], "x double, w double")
    r = df.agg(statistics.weighted_mean(F.col("x"), F.col("w")), statistics.share_at_least(F.col("x"), 3)).first()
    assert r[0] == 2.5 and r[1] == 0.75


def test_segment_means(spark):
    rows = [([1.0, 2.0, 3.0, 4.0, 5.0],), ([7.0],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(statistics.segment_means(F.col("v"), 2)).collect()]
    assert got == [[1.5, 4.0], [7.0, 7.0], None]


def test_dominant_speaker_ties_go_to_the_earliest(spark):
    text = '[{"start": 2, "end": 3, "speaker": "a"}, {"start": 0, "end": 1, "speaker": "b"}, {"start": 5, "end": 5, "speaker": "c"}]'
    segments = diarization.segment_lists(spark.createDataFrame([("k", text)], "k string, segments_json string"), ["k"]).select("k", F.inline("segments"))
    r = diarization.analysis(segments, ["k"]).first()
    assert (r["num_speakers"], r["num_segments"], r["speaker_switches"], r["dominant_speaker"], r["secondary_ratio"]) == (2, 2, 1, "b", 0.5)


def test_retention(spark):
    rows = [("p", "a", 0, 10), ("p", "b", 1, 0), ("p", "c", 2, 5), ("p", "train", 3, 4)]
    df = spark.createDataFrame(rows, "pair string, stage string, k int, num_pairs long")
    got = [r["retention_from_previous_stage"] for r in statistics.with_retention(df, "pair", "k", "stage", ("train",)).orderBy("k").collect()]
    assert got == [None, 0.0, None, None]


def test_column_means_skip_text(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("b", "3", "y"), ("c", "", None)], "id string, m string, t string")
    assert [(r["metric"], r["n"], r["mean"]) for r in statistics.column_means(df, "id").collect()] == [("m", 2, 2.0)]
    with pytest.raises(KeyError):
        statistics.column_means(df, "id", "other")
