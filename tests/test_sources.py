import gzip

import pytest
from corpusloom.sources import tsv


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_three_modes(spark, tmp_path):
    p = put(tmp_path / "a.tsv", "id\tv\ttext\n001\t1.5\tNA\n002\tx\t\n003\n")
    strings = [tuple(r) for r in tsv.read_tsv(spark, p, "strings").orderBy("id").collect()]
    assert strings == [("001", "1.5", "NA"), ("002", "x", ""), ("003", "", "")]
    inferred = [tuple(r) for r in tsv.read_tsv(spark, p, "inferred", {"v": "double"}).orderBy("id").collect()]
    assert inferred == [("001", 1.5, None), ("002", None, None), ("003", None, None)]
    assert [r["text"] for r in tsv.read_tsv(spark, p, "filled").orderBy("id").collect()] == ["", "", ""]
    with pytest.raises(ValueError):
        tsv.read_tsv(spark, p, "other")


def test_gzip_and_several_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt", encoding="utf-8") as f:
        f.write("id\tt\n1\tä\n")
    b = put(tmp_path / "b.tsv", "id\tt\n2\tb\n")
    df = tsv.read_tsv(spark, [str(tmp_path / "a.tsv.gz"), b], "strings")
    assert {tuple(r) for r in df.collect()} == {("1", "ä"), ("2", "b")}


def test_quoted_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi"\tthere'), ("2", "two\nlines"), ("3", ""), ("4", " padded ")]
    out = str(tmp_path / "out")
    tsv.write_tsv(spark.createDataFrame(rows, "id string, t string"), out, single=True)
    assert sorted(tuple(r) for r in tsv.read_tsv(spark, out, "strings", multiline=True).collect()) == rows
    with pytest.raises(Exception, match="already exists"):
        tsv.write_tsv(spark.createDataFrame(rows, "id string, t string"), out)


def test_shards(spark, tmp_path):
    for k, body in enumerate(["id\tp\n1\ta\n", "", "id\tp\n2\tb\n"]):
        (tmp_path / f"shard{k:03}").mkdir()
        put(tmp_path / f"shard{k:03}" / "m.tsv", body)
    assert {tuple(r) for r in tsv.read_shards(spark, str(tmp_path / "shard*/m.tsv"), ["id", "p"]).collect()} == {("1", "a"), ("2", "b")}
    put(tmp_path / "shard001" / "m.tsv", "id\tother\n3\tc\n")
    with pytest.raises(ValueError):
        tsv.read_shards(spark, str(tmp_path / "shard*/m.tsv"), ["id", "p"])


def test_shards_with_quoted_line_breaks(spark, tmp_path):
    rows = [("1", 'say "hi"\tthere'), ("2", "two\nlines"), ("3", "a\nid\tp\r\nid\tother"), ("4", "")]
    for k in range(2):
        tsv.write_tsv(spark.createDataFrame(rows[k::2], "id string, p string"), str(tmp_path / f"shard{k:03}"), single=True)
    assert sorted(tuple(r) for r in tsv.read_shards(spark, str(tmp_path / "shard*"), ["id", "p"], multiline=True).collect()) == rows
    tsv.write_tsv(spark.createDataFrame([("5", "c")], "id string, other string"), str(tmp_path / "shard002"), single=True)
    with pytest.raises(ValueError):
        tsv.read_shards(spark, str(tmp_path / "shard*"), ["id", "p"], multiline=True)


def test_queries_scan_quoted_fields(spark, tmp_path):
    from corpusloom.plans import evaluation

    texts = ['say "hi"', "tab\there", "two\nlines", "", "NA", None]
    rows = [(i, f"id{i}", "s.wav", "t.wav", t, t, "en", "es", "show") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "line_no bigint, sample_id string, src_audio string, tgt_audio string, src_text string, tgt_text string, src_lang string, tgt_lang string, show_id string")
    df.selectExpr("*", "timestamp'2024-01-02 03:04:05' AS ingested_at").write.parquet(f"{tmp_path}/{evaluation.MANIFEST}.parquet")
    for name, want in (
        ("tsv_strings", [*texts[:3], "", "NA", ""]), ("tsv_inferred", [*texts[:3], None, None, None]),
        ("tsv_filled", [*texts[:3], "", "", ""]), ("shard_union", [*texts[:3], "", "NA", ""]),
    ):
        got = {r["sample_id"]: (r["src_text"], r["tgt_text"]) for r in evaluation.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {f"id{i}": (t, t) for i, t in enumerate(want)}, name


def test_pairs_with_and_without_id(spark, tmp_path):
    new = put(tmp_path / "n.tsv", "id\tsource\ttarget\toutput\nx\ta\tb\tc\n")
    old = put(tmp_path / "o.tsv", " Source\tTARGET\toutput\tmore\na\tb\tc\tx\nd\te\tf\n")
    assert [tuple(r) for r in tsv.read_pairs(spark, new).collect()] == [("x", "a", "b", "c")]
    assert sorted(tuple(r) for r in tsv.read_pairs(spark, old).collect()) == [("0", "a", "b", "c"), ("1", "d", "e", "f")]
    with pytest.raises(ValueError, match="expected the columns"):
        tsv.read_pairs(spark, put(tmp_path / "w.tsv", "src\ttgt\tout\na\tb\tc\n"))


def test_files_are_united_by_name(spark, tmp_path):
    a = put(tmp_path / "a.tsv", "id\tsrc\ttgt\n1\ta\tb\n")
    b = put(tmp_path / "b.tsv", "tgt\tid\tmore\nB\t2\tx\n")
    c = put(tmp_path / "c.tsv", "")
    got = [r.asDict() for r in tsv.read_tsv(spark, [a, b, c], "strings").orderBy("id").collect()]
    assert got == [{"id": "1", "src": "a", "tgt": "b", "more": ""}, {"id": "2", "src": "", "tgt": "B", "more": "x"}]
    assert [r["src"] for r in tsv.read_tsv(spark, [a, b], "inferred").orderBy("id").collect()] == ["a", None]
    assert tsv.read_tsv(spark, str(tmp_path / "*.tsv"), "strings").count() == 2
    with pytest.raises(ValueError, match="stands twice"):
        tsv.read_tsv(spark, put(tmp_path / "d.tsv", "id\tid\n1\t2\n"), "strings")
    comma = put(tmp_path / "e.csv", 'id,text\n1,"a, ""b"""\n')
    assert [tuple(r) for r in tsv.read_tsv(spark, comma, "strings", sep=",").collect()] == [("1", 'a, "b"')]


def test_shard_of_another_header_is_an_error(spark, tmp_path):
    for k, body in enumerate(["id\tsrc\ttgt\n1\ta\tb\n", "uid\ttgt\tsrc\n2\tB\tA\n"]):
        (tmp_path / f"shard{k}").mkdir()
        put(tmp_path / f"shard{k}" / "m.tsv", body)
    for header in (None, ["id", "src", "tgt"]):
        with pytest.raises(ValueError, match="uid"):
            tsv.read_shards(spark, str(tmp_path / "shard*/m.tsv"), header)


def test_appended_and_copied(spark, tmp_path):
    out = str(tmp_path / "log")
    for k in range(3):
        tsv.append_tsv(spark.createDataFrame([(str(k), 'a\t"b"')], "id string, t string"), out)
    assert sorted(tuple(r) for r in tsv.read_tsv(spark, out, "strings").collect()) == [(str(k), 'a\t"b"') for k in range(3)]
    with pytest.raises(ValueError):
        tsv.append_tsv(spark.createDataFrame([("1", "x")], "id string, other string"), out)
    lines = put(tmp_path / "p.txt", "at /a/b\n/a\n\nend")
    assert tsv.copied(spark.read.text(lines), {"/a": "A", "/a/b": "B"}, str(tmp_path / "copy")) == 4
    assert {r[0] for r in spark.read.text(str(tmp_path / "copy")).collect()} == {"at B", "A", "", "end"}
    parts = [put(tmp_path / f"{k}.txt", body) for k, body in enumerate(["a\nb", "", "c\n"])]
    joined = tsv.joined_texts(spark, [parts[0], str(tmp_path / "none.txt"), *parts[1:]])
    assert [r["value"] for r in joined.orderBy("part", "line").collect()] == ["a", "b", "c"]
    assert {r["length"] for r in tsv.files_in(spark, str(tmp_path / "1.txt")).collect()} == set()


def test_small_text_sources(spark, tmp_path):
    numbers = put(tmp_path / "n.txt", "score 1 of 2.5\n\nnothing\n-3\n")
    assert [r[0] for r in tsv.read_numbers(spark, numbers).collect()] == [2.5, -3.0]
    lines = put(tmp_path / "l.txt", "a\n\n a \nb\n")
    assert {r[0] for r in tsv.read_line_set(spark, lines).collect()} == {"a", "b"}
    cache = put(tmp_path / "c.tsv", "audio_path\tduration_sec\na\t1\n\t5\nb\tx\na\t2\n")
    assert {tuple(r) for r in tsv.read_cache(spark, cache, "audio_path", "duration_sec", number=True).collect()} == {("a", 2.0)}
    assert tsv.read_cache(spark, cache, "audio_path", "other").count() == 0
    assert tsv.read_summary(spark, str(tmp_path / "none.json")) == {}
    tsv.write_summary({"b": 1, "ä": [2]}, spark, str(tmp_path / "s"))
    assert tsv.read_summary(spark, str(tmp_path / "s")) == {"b": 1, "ä": [2]}
    assert [r.asDict() for r in tsv.read_tsv(spark, str(tmp_path / "s.tsv"), "strings").collect()] == [{"b": "1", "ä": "[2]"}]


def test_release(spark):
    df = tsv.inventory(spark, [{"stage": "s", "bytes": 7}, {"note": None, "kind": "k"}])
    assert df.columns == list(tsv.INVENTORY_FIELDS)
    assert df.collect()[0]["bytes"] == "7" and df.collect()[1]["note"] == ""
    assert tsv.rewrite_tree({"/a/b": ["/a/b/c", 1, None]}, {"/a": "A", "/a/b": "B"}) == {"B": ["B/c", 1, None]}


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}, "c": ""}')
    assert tsv.read_config(spark, str(tmp_path / "c.json"), ("a",)) == {"a": {"b": 1}, "c": ""}
    with pytest.raises(ValueError, match="'c', 'd'"):
        tsv.read_config(spark, str(tmp_path / "c.json"), ("a", "c", "d"))
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a:\n  b: 1\nc: [x, y]\n")
    assert tsv.read_config(spark, str(tmp_path / "c.yaml")) == {"a": {"b": 1}, "c": ["x", "y"]}
