import datetime as dt

from corpusloom.operators.incremental import latest_progress
from corpusloom.streaming import progress


def rows(n):
    t0 = dt.datetime(2024, 1, 1)
    return [(f"k{i % 7}", i, "done" if i % 3 else "error", t0 + dt.timedelta(minutes=7 * i)) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(60), "id string, seq int, status string, at timestamp")
    src = str(tmp_path / "in")
    df.repartition(5).write.parquet(src)
    q = progress.latest_state(progress.stream_parquet(spark, src, 2), ["id"], ["seq"], ["status", "seq"]).writeStream.format("memory").queryName("latest_state").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    want = {(r["id"], r["status"], r["seq"]) for r in latest_progress(df, ["id"], ["seq"]).collect()}
    assert {tuple(r) for r in spark.table("latest_state").collect()} == want

    out = str(tmp_path / "out")
    q = progress.stream_parquet(spark, src, 2).writeStream.foreachBatch(progress.upsert_latest(out, ["id"], ["seq"])).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert {(r["id"], r["status"], r["seq"]) for r in progress.current_state(spark, out).collect()} == want


def test_batches_rewrite_what_they_touch(spark, tmp_path):
    out = str(tmp_path / "state")
    schema = "id string, seq int"
    fold = progress.upsert_latest(out, ["id"], ["seq"], buckets=8)
    first = spark.createDataFrame([(f"k{i}", 1) for i in range(20)], schema)
    fold(first, 0)
    for number in (1, 2, 3, 3):
        fold(spark.createDataFrame([("k0", number + 1), ("k0", 0), ("new", number)], schema), number)
    state = {r["id"]: r["seq"] for r in progress.current_state(spark, out).collect()}
    assert state == {f"k{i}": 1 for i in range(1, 20)} | {"k0": 4, "new": 3}
    assert len(list((tmp_path / "state" / "version=3").glob("bucket=*"))) <= 2
    assert not list((tmp_path / "state" / "version=1").glob("bucket=*/*.parquet"))
    assert progress.current_state(spark, str(tmp_path / "none")) is None


def test_windows_with_watermark(spark, tmp_path):
    df = spark.createDataFrame(rows(60), "id string, seq int, status string, at timestamp")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = progress.status_windows(progress.stream_parquet(spark, src), "at", "status").writeStream.format("memory").queryName("status_windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("status_windows").collect()) == 60
