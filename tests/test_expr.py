"""Traps of missing values, text flags, numbers and nested text, on literal rows."""

import math

import pytest
from corpusloom.functions import expr as X
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, value, kind, make):
    return values(spark, [(value,)], f"c {kind}", make(F.col("c")))[0]


def test_truthy(spark):
    rows = [(v,) for v in ("1", " TRUE\t", "yes", "Y", "1.0", "done", "", None, "no")]
    assert values(spark, rows, "c string", X.truthy(F.col("c"))) == [True, True, True, True, False, False, False, False, False]
    assert values(spark, rows, "c string", X.truthy(F.col("c"), X.TRUE_WORDS_WIDE))[5] is True
    assert values(spark, [(True,), (False,), (None,)], "c boolean", X.truthy(F.col("c"))) == [True, False, False]


def test_languages(spark):
    rows = [(v,) for v in (" EN ", "deu", "xx", "", None)]
    assert values(spark, rows, "c string", X.normalize_language(F.col("c"))) == ["eng", "deu", "xx", "", ""]
    assert values(spark, [("De",), ("Klingon ",), (None,)], "c string", X.text_language(F.col("c"))) == ["deu_Latn", "Klingon", None]
    assert values(spark, [("es",), (None,)], "c string", X.speech_encoder(F.col("c"))) == ["sonar_speech_encoder_spa", None]
    with pytest.raises(PySparkException):
        values(spark, [("xx",)], "c string", X.speech_encoder(F.col("c")))


def test_numbers(spark):
    rows = [(v,) for v in ("1.5", " 2 ", "1.5d", "1e3", "nan", "inf", "", "x", None, "-.5")]
    assert values(spark, rows, "c string", X.to_number(F.col("c"))) == [1.5, 2.0, None, 1000.0, None, None, None, None, None, -0.5]


def test_two_sided_scores(spark):
    rows = [(1.0, 2.0), (None, 2.0), (math.nan, 2.0), (0.0, 2.0), (4.0, 2.0)]
    a, b = F.col("a"), F.col("b")
    schema = "a double, b double"
    assert values(spark, rows, schema, X.combine(a, b, "mean")) == [1.5, None, None, 1.0, 3.0]
    assert values(spark, rows, schema, X.combine(a, b, "min")) == [1.0, None, None, 0.0, 2.0]
    assert values(spark, rows, schema, X.compliance(a, b)) == [0.5, None, None, None, 0.5]
    assert values(spark, rows[:2], schema, X.abs_log_ratio(a, b)) == [math.log(2), None]
    with pytest.raises(ValueError):
        X.combine(a, b, "max")


def test_text(spark):
    assert one(spark, " a \t b\n", "string", X.clean_text) == "a b"
    assert one(spark, "a/bc/d", "string", lambda c: X.replace_all(c, {"a": "1", "a/b": "2"})) == "2c/d"
    assert one(spark, "x\nscore: 7\nscore: 8", "string", lambda c: X.captured(c, r"^score: (\d+)$", True)) == "7"
    assert one(spark, "nothing", "string", lambda c: X.captured(c, r"\d+", False)) is None
    assert one(spark, "a\nb\r", "string", X.one_line) == "a\\nb\\r"
    assert values(spark, [("/a/b.c.wav",), ("plain",), ("/x/.hidden",)], "c string", X.stem(F.col("c"))) == ["b.c", "plain", ".hidden"]


def test_json(spark):
    assert one(spark, '{"a": {"b": 3}}', "string", lambda c: X.nested_text(c, "a.b")) == "3"
    assert one(spark, '[{"x": 1}, {"a": {"b": "y"}}]', "string", lambda c: X.nested_text(c, "a.b")) == "y"
    assert one(spark, '{"q": {"score": 2}, "r": 1}', "string", lambda c: X.shallow_text(c, "score")) == "2"
    rows = [(v,) for v in ('{"text": "t", "words": ["a"]}', '{"text": "t", "words": [" "]}', '{"text": "t", "words": []}', '{"words": ["a"]}', "broken", None)]
    assert values(spark, rows, "c string", X.utterance_is_valid(F.col("c"))) == [True, False, False, False, False, False]


def test_vad(spark):
    rows = [(v,) for v in ("0.1:1.5 2:3.25", "x 1:y 3:2 4:5", "", None)]
    assert [v and round(v, 6) for v in values(spark, rows, "c string", X.vad_span(F.col("c")))] == [3.15, 1.0, None, None]


def test_codes(spark):
    schema = "c string, s string"
    stack = X.code_stack(F.col("c"), F.col("s"))
    assert values(spark, [("1 2 3 4 5 6", "1x2x3"), ("1 2", "1x2x3"), (None, "1x1x1"), ("1 2", "bad")], schema, stack) == [[[1, 2, 3], [4, 5, 6]], None, None, None]
    assert values(spark, [("1 2 3 4", "1x4x1")], schema, X.code_stack(F.col("c"), F.col("s"), 2)) == [[[1], [2]]]
    assert one(spark, [2, 0, 1], "array<int>", X.inverse_order) == [1, 2, 0]
    assert one(spark, [[1, 2], [3, 4], [5, 6]], "array<array<int>>", X.transpose) == [[1, 3, 5], [2, 4, 6]]
    assert one(spark, [5, 6], "array<int>", lambda c: X.unwrapped(X.wrapped(c, 1, 2))) == [5, 6]
    assert one(spark, [5, 6], "array<int>", lambda c: X.padded(c, F.lit(4), 0)) == [5, 6, 0, 0]
    assert one(spark, ["a", "b", "a", "b", "a"], "array<string>", lambda c: X.repeated_ngram_count(c, 2)) == 2
    assert one(spark, ["a"], "array<string>", lambda c: X.repeated_ngram_count(c, 2)) == 0
    ordered = X.code_stack(F.col("c"), F.col("s"), 3, [2, 0])
    assert values(spark, [("1 2 3 4", "1X4x1"), ("1 2", "1x2x1"), ("1 2 3", "2x3x1"), ("", "1x0x1")], schema, ordered) == [[[3], [1], [3]], None, None, None]


def test_sequences(spark):
    tokens = [5, 6, 7, 5, 6, 8, 5, 6]
    assert one(spark, tokens, "array<int>", lambda c: X.banned_continuations(c, 3)) == [7, 8]
    assert one(spark, tokens, "array<int>", lambda c: X.banned_continuations(c, 1)) == [5, 6, 7, 8]
    assert one(spark, [5], "array<int>", lambda c: X.banned_continuations(c, 3)) == []
    assert one(spark, [5, 6], "array<int>", lambda c: X.banned_continuations(c, 3)) == []
    assert one(spark, [1, 2, 3, 4], "array<int>", lambda c: X.within_budget(c, 5, 8, 9)) == [8, 1, 2, 3, 9]
    assert one(spark, [1, 2, 3, 4], "array<int>", lambda c: X.within_budget(c, 7, 8, 9, (50,), (60, 61), True)) == [8, 50, 60, 1, 2, 61, 9]
    assert one(spark, [1], "array<int>", lambda c: X.within_budget(c, 0, 8, 9)) == [8, 9]
    assert one(spark, [[1, 2, 3], [4, 5, 6]], "array<array<int>>", lambda c: X.frames_first(c, 2)) == [[1, 4], [2, 5], [3, 6]]
    assert one(spark, [[1, 4], [2, 5], [3, 6]], "array<array<int>>", lambda c: X.frames_first(c, 2)) == [[1, 4], [2, 5], [3, 6]]
    assert one(spark, [[1, 2]], "array<array<int>>", lambda c: X.frames_first(c, 5)) is None


def test_commands(spark):
    rows = [(" [a, b ,, c ] ",), ("a, b",), ("[]",), (None,)]
    assert values(spark, rows, "c string", X.bracketed(F.col("c"))) == ["[a,b,c]", "a, b", "[]", None]
    command = "run +out.path='/a/b' n=3"
    assert one(spark, command, "string", lambda c: X.override(c, "out.path")) == "/a/b"
    assert one(spark, command, "string", lambda c: X.override(c, "path")) is None
    assert one(spark, command, "string", lambda c: X.with_override(c, "n", F.lit("4"))) == "run +out.path='/a/b' n=4"
    with pytest.raises(Exception, match="no override m"):
        one(spark, command, "string", lambda c: X.with_override(c, "m", F.lit("4")))
    assert one(spark, " DEU ", "string", X.recogniser_language) == "german"


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])]
    got = values(spark, rows, "a array<double>, b array<double>", X.cosine(F.col("a"), F.col("b")))
    assert round(got[0], 6) == 0.707107 and got[1:] == [None, None, None]
    assert one(spark, [math.nan, -2.0, 1.0], "array<double>", X.peak_normalized) == [0.0, -1.0, 0.5]
