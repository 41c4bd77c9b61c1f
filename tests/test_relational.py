import pytest
from corpusloom.operators import incremental, relational, selection, statistics
from corpusloom.sources import tsv
from pyspark.sql import functions as F


def test_positions_and_ties(spark):
    df = spark.createDataFrame([(f"id{i:03}", float(i % 7)) for i in range(300)], "id string, s double").repartition(5)
    got = {r["id"]: r["position"] for r in relational.with_position(df, ["s", "id"]).collect()}
    want = {i: k for k, (_, i) in enumerate(sorted((float(i % 7), f"id{i:03}") for i in range(300)))}
    assert got == want


def test_top_n_puts_nan_and_null_last(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", None), ("c", 1.0), ("d", 2.0), ("e", 2.0)], "id string, s double")
    kept = lambda n: {r["id"] for r in selection.top_n(df, "s", n, "id").filter("selected").collect()}
    assert kept(2) == {"d", "e"} and kept(3) == {"c", "d", "e"} and len(kept(4)) == 4
    assert selection.by_cutoff(df, "s", 1.5).filter("selected").count() == 2
    with pytest.raises(ValueError):
        selection.top_n(df, "s", 6, "id")


def test_splits(spark):
    df = spark.createDataFrame([(i,) for i in range(205)], "id long")
    got = {r["split"]: r["n"] for r in selection.assign_splits(df, "id", 0.1, 7).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"test": 7, "dev": round(20.5) - 7, "train": 205 - round(20.5)}
    again = selection.assign_splits(df.repartition(3), "id", 0.1, 7)
    assert again.join(selection.assign_splits(df, "id", 0.1, 7), ["id", "split"]).count() == 205
    for ratio, size in ((0.01, 7), (0.1, 0)):
        with pytest.raises(ValueError):
            selection.assign_splits(df, "id", ratio, size)
    assert selection.sample_exact(df, "id", 0.001).count() == 1
    assert selection.sample_exact(df, "id", 1).count() == 205


def test_coverage_errors(spark):
    m = spark.createDataFrame([("a",), ("b",)], "id string")
    s = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "id string, s double")
    with pytest.raises(ValueError, match="Missing scores"):
        relational.covered_join(m, s, "id", ["s"])
    with pytest.raises(ValueError, match="unknown ids"):
        relational.covered_join(m.limit(1), s, "id", ["s"])
    assert relational.covered_join(m.limit(1), s, "id", ["s"], allow_extra=True).count() == 1
    with pytest.raises(ValueError, match="Duplicate"):
        relational.covered_join(m.union(m), s, "id", ["s"])
    with pytest.raises(ValueError, match="Missing required"):
        relational.covered_join(m, s, "id", ["t"])


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "id int, text_asr string, my_whisper int, x_asr_y int, keep int")
    assert relational.drop_recognised(df).columns == ["id", "keep"]
    assert relational.existing(df, ["keep", "none", "id"]).columns == ["keep", "id"]
    left, right = spark.createDataFrame([(1, "l")], "id int, v string"), spark.createDataFrame([(1, "r", "w")], "id int, v string, w string")
    assert relational.join_metadata(left, right, "id", "id").columns == ["id", "v", "aligned_v", "w"]
    assert relational.join_metrics(left, {"m": right}, "id").columns == ["id", "v", "m_v", "w"]
    assert relational.best_rate_column(["a", "rate_char", "speech_rate_word", "speech_rate_syllable"]) == "speech_rate_syllable"
    assert relational.best_rate_column(["a"]) is None
    assert relational.merge_key(left, right) == "id"
    with pytest.raises(ValueError):
        relational.resolve_id(left, "nope")


def test_gates(spark):
    rows = [(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.04, 0.9), (2, 0.06, 0.9), (None, None, None)]
    df = spark.createDataFrame(rows, "n int, r double, s double")
    got = df.select(relational.strict_single_speaker(F.col("n")), relational.relaxed_single_speaker(F.col("n"), F.col("r"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, True), (False, True), (False, False), (False, False)]
    flags = spark.createDataFrame([("1", "done"), ("0", "done"), ("yes", "error")], "source_clearvoice_ok string, status string")
    assert [r[0] for r in flags.select(relational.preprocess_success(flags)).collect()] == [True, False, False]


def test_sides(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", None, 3)], "id string, s int, t int")
    long = relational.to_sides(df, "id", {"v": ("s", "t")})
    assert long.count() == 4
    assert {tuple(r) for r in relational.to_pairs(long, ["v"]).collect()} == {("a", 1, 2), ("b", None, 3)}


def test_resume(spark):
    log = spark.createDataFrame([("a", 1, "error"), ("a", 2, "done"), ("b", 1, "done"), ("b", 2, "error"), ("c", 1, "error")], "id string, seq int, status string")
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    left = lambda **k: {r[0] for r in incremental.pending(work, log, ["id"], ["seq"], **k).collect()}
    assert left() == {"d"} and left(rerun_errors=True) == {"b", "c", "d"}
    calls = []

    def score(d):
        calls.append(sorted(r[0] for r in d.collect()))
        return d.withColumn("n", F.length("k"))

    rows = spark.createDataFrame([("x",), ("x",), ("yy",), (None,)], "k string")
    cache = spark.createDataFrame([("yy", 9)], "k string, n int")
    assert sorted((r["k"] or "", r["n"]) for r in incremental.memoised(rows, "k", score, cache).collect()) == [("", None), ("x", 1), ("x", 1), ("yy", 9)]
    assert calls == [["x"]]
    prior = spark.createDataFrame([("a", "p", 5), ("b", "q", 0), ("c", "r", 7)], "id string, path string, bytes long")
    now = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "other")], "id string, path string")
    assert {r["id"] for r in incremental.reusable(now, prior, "id", ["path"], "bytes").collect()} == {"a"}
    assert incremental.same_contract({"n": 1}, {"n": 1}) and not incremental.same_contract({"n": 1}, {"n": 1, "m": None})


def test_hot_key_lookup(spark):
    from corpusloom.staging import lookup_join

    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i % 40}", i) for i in range(600)], "k string, i int")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    want = {(r["k"], r["i"], r["n"]) for r in rows.join(lookup, "k").collect()}
    for k in ({}, {"max_rows": 2, "weight": "n"}, {"max_rows": 2, "salts": 4}):
        got = [(r["k"], r["i"], r["n"]) for r in lookup_join(rows, lookup, "k", **k).collect()]
        assert len(got) == 600 and set(got) == want


def test_isolated_failures(spark):
    def score(values):
        if "bad" in values:
            raise RuntimeError("no\nuse")
        return [v.upper() for v in values if v != "lost"]

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "bad", "b", "", "lost", "c"] * 20)], "i int, v string").coalesce(1)
    for size in (1, 4, 500):
        got = {r["i"]: (r["text"], r["status"], r["error"]) for r in incremental.isolated(rows, "v", score, "text", size).collect()}
        assert len(got) == 120
        assert got[0] == ("A", "done", None) and got[1] == (None, "error", "RuntimeError: no\\nuse")
        assert got[3][1] == got[4][1] == "error" and got[5][0] == "C"
    assert incremental.isolated(rows.limit(0), "v", score, "text").count() == 0


def test_assembly_and_resume(spark, tmp_path):
    pairs = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "a", "z"), ("4", None, "x")], "id string, s string, t string")
    src = spark.createDataFrame([("a", "A"), ("b", "B")], "p string, text string")
    tgt = spark.createDataFrame([("x", "X"), ("z", "Z")], "p string, text string")
    failed = spark.createDataFrame([("z",)], "p string")
    out = incremental.assembled(pairs, {"sentence": ("s", src, failed), "translation": ("t", tgt, failed)}, ("t", tgt.filter("p = 'z'"), "extra"))
    assert [r.asDict() for r in out.collect()] == [{"id": "1", "s": "a", "t": "x", "sentence": "A", "translation": "X", "extra": ""}]
    folder, data = str(tmp_path / "run"), str(tmp_path / "in")
    pairs.coalesce(1).write.parquet(data)
    wanted = incremental.contract(spark, data, model="m", batch=8)
    assert incremental.resumed(spark, folder, wanted, pairs, ["id"]).count() == 4
    pairs.filter("id < '3'").write.parquet(f"{folder}/done")
    assert {r["id"] for r in incremental.resumed(spark, folder, wanted, pairs, ["id"]).collect()} == {"3", "4"}
    with pytest.raises(ValueError, match="have changed"):
        incremental.resumed(spark, folder, wanted | {"batch": "9"}, pairs, ["id"])
    pairs.coalesce(1).write.mode("append").parquet(data)
    with pytest.raises(ValueError, match="have changed"):
        incremental.resumed(spark, folder, incremental.contract(spark, data, model="m", batch=8), pairs, ["id"])
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("")
    work = spark.createDataFrame([(str(tmp_path / n),) for n in "abc"], "out string")
    files = tsv.files_in(spark, str(tmp_path)).filter("path not like '%/in/%' and path not like '%/run/%'")
    assert {r[0][-1] for r in incremental.without_output(work, "out", files).collect()} == {"b", "c"}


def test_staged_tables_are_released(spark):
    from corpusloom import staging

    kept, staging._staged = staging._staged, []
    try:
        df = staging.stage(spark.range(3), "x")
        path = staging._staged[0]
        assert df.count() == 3 and staging.release(spark) == 1
        assert not tsv.exists(spark, path)
    finally:
        staging._staged = kept


def test_counts_and_ranks(spark):
    a = spark.createDataFrame([("1", True), ("1", False), ("2", True), ("3", None)], "id string, ok boolean")
    b = spark.createDataFrame([("1", True), ("2", False), ("4", True), (None, True)], "id string, ok boolean")
    got = statistics.filter_counts(a, b, "id", "ok").first().asDict()
    assert got == {"src_raw": 4, "tgt_raw": 4, "src_matched": 3, "tgt_matched": 2, "kept": 1, "src_invalid": 2, "tgt_invalid": 1, "dropped": 2, "src_unmatched": 1, "tgt_unmatched": 2}
    rows = spark.createDataFrame([("g", float(v)) for v in [1, 1, 2, 5, 9]] + [(None, 3.0)], "g string, v double")
    ranks = {(r["g"], r["v"]): r["r"] for r in selection.ranks_with_ties(rows, "v", ["g"], "r").collect()}
    assert ranks == {("g", 1.0): 1.5, ("g", 2.0): 3.0, ("g", 5.0): 4.0, ("g", 9.0): 5.0, (None, 3.0): 1.0}
    q = {r["g"]: (r["m"], r["p"]) for r in selection.quantiles(rows, "v", ["g"], {"m": 0.5, "p": 0.9}).collect()}
    assert q["g"][0] == 2.0 and abs(q["g"][1] - 7.4) < 1e-9 and q[None] == (3.0, 3.0)
    for n, limit in ((0, 9), (2, 9), (2, 1), (5, 9)):
        selection.TOP, before = limit, selection.TOP
        kept = [r["v"] for r in selection.top_n(rows.filter("g is not null").withColumn("i", F.monotonically_increasing_id()), "v", n, "i").filter("selected").collect()]
        selection.TOP = before
        assert sorted(kept, reverse=True) == [9.0, 5.0, 2.0, 1.0, 1.0][:n]
