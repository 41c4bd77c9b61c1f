import json
import random

from corpusloom.operators.intervals import paired, periods_and_gaps, read_segments, speech_periods

SCHEMA = "row_id string, side string, segments_json string"


def brute(rows):
    by = {}
    for row_id, side, text in rows:
        for s, e, who in read_segments(text):
            by.setdefault((row_id, side, who), set()).add((s, e))
    out = set()
    for key, segs in by.items():
        merged = []
        for s, e in sorted(segs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*key, "period", s, e) for s, e in merged}
        out |= {(*key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_logs_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):
        segs = []
        for _ in range(rng.randint(0, 30)):
            s = round(rng.choice([rng.uniform(0, 20), rng.uniform(0, 900)]), 3)
            segs.append([s, round(s + rng.choice([0, -1, 0.001, rng.uniform(0, 5), rng.uniform(0, 300)]), 3), f"s{rng.randint(0, 2)}"])
        rows.append((f"r{k % 40}" if k % 13 else None, rng.choice(["source", "target", None]), json.dumps(segs)))
    rows += rows[:20]
    assert rows_of(speech_periods(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert rows_of(speech_periods(spark.createDataFrame(rows, SCHEMA), bucket_ms=1500)) == brute(rows)


def test_one_entity_holds_nearly_all(spark):
    rows = [("hot", "source", json.dumps([[i * 0.01, i * 0.01 + 0.007, "a"]])) for i in range(5000)] + [("cold", "source", '[["1","2","a"]]')]
    assert rows_of(speech_periods(spark.createDataFrame(rows, SCHEMA), bucket_ms=1000)) == brute(rows)


def test_notations():
    want = [(1000, 2500, "a")]
    for text in (
        '[{"start": 1, "end": 2.5, "speaker": "a"}]', '[{"begin": 1, "end": 2.5, "label": "a"}]', '[{"start_time": "1", "end_time": "2.5", "speaker_id": "a"}]',
        '[[1, 2.5, "a"]]', '["1 2.5 a"]', '["1, 2.5, a"]', '[[{"start": 1, "end": 2.5, "speaker": "a"}]]', '{"start": 1, "end": 2.5, "speaker": "a"}', '[null, 7, ["1", "2.5", "a"], {"start": 3}]',
    ):
        assert read_segments(text) == want, text
    for text in (None, "", "nonsense", "[[1,2", '[{"start": 2, "end": 2, "speaker": "a"}]', "[]", '[[3, 1, "a"]]', "7", "[true]"):
        assert read_segments(text) == [], text


def test_touching_and_nested():
    assert paired([0, 10, 12, 30], [10, 20, 15, 31]) == [(0, 20), (30, 31)]


def test_empty_table_nulls_and_clashing_names(spark):
    assert periods_and_gaps(spark.createDataFrame([], "k string, start_ms long, end_ms long"), ["k"]).count() == 0
    rows = [("x", None, 5, 1), ("x", 1, None, 1), ("x", 1, 4, 1), ("x", 9, 9, 1)]
    df = spark.createDataFrame(rows, "k string, start_ms long, end_ms long, kind int")
    assert rows_of(periods_and_gaps(df, ["k"])) == {("x", "period", 1, 4)}
