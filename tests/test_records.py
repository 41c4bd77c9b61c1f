import random

import pyarrow as pa
from corpusloom.sources import records
from corpusloom.sources.records import Loader, diagnose, loaded, parse_records, rejected

GOOD = ["id", "a.wav", "b.wav", "Hello", "Hola", "en", "es"]


def line(**at):
    return "\t".join(at.get(f"f{i}", v) for i, v in enumerate(GOOD))


CASES = {
    line(): None,
    line() + "\r": None,
    line(f3='"He said ""hi"",\tthen\nleft"'): None,
    line(f1="A.WAV"): None,
    line(f6=""): None,
    line(f3='"open'): "quoting",
    line(f3='"a" b'): "quoting",
    line(f3='a "b"'): "quoting",
    line(f3='a "b"') + "\textra": "quoting",
    line() + "\t": "column_count",
    "": "column_count",
    line(f3="---"): "value",
    line(f4=" nUll "): "value",
    line(f4="N/A"): "value",
    line(f3="bad � text"): "value",
    line(f1="a.mp3"): "value",
    line(f3=""): "value",
    line(f3="two\nlines"): None,
}


def test_each_reason():
    for text, reason in CASES.items():
        assert diagnose(text)[1] == reason, text


def test_blocks_agree_with_strict_reading():
    rng = random.Random(3)
    alphabet = ['"', "\t", "\n", "a", "NA", " ", "�", '""', ".wav", "x y"]
    lines = [*CASES, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(300)), *[line()] * 200, *(line(f3="".join(rng.choice(alphabet) for _ in range(4))) for _ in range(300))]
    rng.shuffle(lines)
    stripped = [x[:-1] if x.endswith("\r") else x for x in lines]
    for block in (1, 7, 512):
        columns, reasons = Loader(block, 512).load(pa.array(stripped))
        for k, text in enumerate(stripped):
            fields, reason = diagnose(text)
            assert reasons[k] == reason and [c[k] for c in columns] == (fields or [None] * 7), text


def test_strict_reader_sees_single_bad_records_only(monkeypatch):
    seen = []
    monkeypatch.setattr(records, "diagnose", lambda x: seen.append(x) or diagnose(x))
    quoted = line(f3='"He said ""hi"",\tthen\nleft"')
    clean = [line(), quoted] * 128
    assert Loader(256, 256).load(pa.array(clean))[1] == [None] * 256 and not seen
    bad = [line(f3='"a" b'), line(f3='a "b"'), line() + "\t", line(f3='"open'), line(f3="NA")]
    for k, text in enumerate(bad):
        some = clean[:]
        some[50 * k + 3] = text
        seen.clear()
        columns, reasons = Loader(256, 256).load(pa.array(some))
        assert seen == [text] and [k for k, r in enumerate(reasons) if r] == [50 * k + 3]
        assert columns[3][0] == "Hello" and columns[3][1] == 'He said "hi",\tthen\nleft'


def test_spark_nulls_empty_and_extra_columns(spark):
    rows = [(i, text, "x") for i, text in enumerate(CASES)] + [(None, None, "x"), (99, line(f3="y" * 300_000), "x")]
    df = spark.createDataFrame(rows, "n long, raw string, reason string")
    parsed = parse_records(df, "n", "raw", block=7)
    assert {tuple(r) for r in rejected(parsed, "n").collect()} == {(i, r) for i, r in enumerate(CASES.values()) if r} | {(None, "column_count")}
    assert loaded(parsed).count() == sum(r is None for r in CASES.values()) + 1
    assert parse_records(df.limit(0), "n", "raw").count() == 0
