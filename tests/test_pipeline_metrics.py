import pytest
from corpusloom.operators import metrics
from corpusloom.plans.pipeline import Pipeline
from pyspark.sql import functions as F


def test_pipeline_accounts_for_every_row(spark):
    rows = [(i, "p" if i % 2 else "q", i % 3 == 0, None if i == 6 else i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, pair string, a boolean, b boolean")
    p = Pipeline(df).gate("first", F.col("a")).gate("second", F.col("b"))
    assert {r["id"] for r in p.kept().collect()} == {i for i in range(0, 60, 6) if i != 6}
    assert p.kept("first").count() == 20 and p.kept("raw").count() == 60
    assert p.kept().count() + p.dropped().count() == 60
    assert {r["dropped_by"]: r["n"] for r in p.dropped().groupBy("dropped_by").agg(F.count("*").alias("n")).collect()} == {"first": 40, "second": 11}
    funnel = {(r["pair"], r["stage"]): (r["num_pairs"], r["retention_from_previous_stage"]) for r in p.funnel(F.col("pair"), F.lit(3600.0), F.lit(0.0)).collect()}
    assert funnel[("q", "raw")] == (30, None) and funnel[("q", "second")] == (9, 0.9) and ("p", "second") not in funnel


def test_metric_registry_and_precedence(spark):
    registry = metrics.Registry()

    @registry.add("length")
    def length(m):
        return m.select("sample_id", F.length("t").cast("string").alias("score"))

    @registry.add("other")
    def other(m):
        return m.select("sample_id", F.lit("2").alias("score"), F.lit("text").alias("note"))

    m = spark.createDataFrame([("a", "xx"), ("b", "yyyy")], "sample_id string, t string")
    per = registry.per_example(m, ["length", "other"])
    assert per.columns == ["sample_id", "score", "other_score", "note"]
    with pytest.raises(ValueError):
        registry.per_example(m, ["none"])
    got = metrics.aggregate(per, [{"score_mean": 1, "x": 5}, {"score_mean": 9, "pause_joint_score": 0.5}])
    assert {r["key"]: r["value"] for r in got.collect()} == {"score_mean": 9.0, "other_score_mean": 2.0, "pause_joint_score_mean": 0.5}
    rows = metrics.table(got, [("A", ["missing_mean", "other_score_mean"]), ("B", ["missing_mean"])]).orderBy("at").collect()
    assert [(r["name"], r["value"]) for r in rows] == [("A", 2.0), ("B", None)]
