import json

import pytest
from corpusloom.plans import construction

OBJECTS = [{"start": 0.5, "end": 2.0, "speaker": "a"}, {"start": 2.0, "end": 2.5, "speaker": "b"}, {"start": 3.0, "end": 3.0, "speaker": "b"}, {"start": 3.0, "end": 4.0, "speaker": "a"}]
TEXTS = {
    "objects": json.dumps(OBJECTS),
    "begin": json.dumps([{"begin": s["start"], "end": s["end"], "label": s["speaker"]} for s in OBJECTS]),
    "start_time": json.dumps([{"start_time": str(s["start"]), "end_time": str(s["end"]), "speaker_id": s["speaker"]} for s in OBJECTS]),
    "speaker_first": json.dumps([dict(reversed(s.items())) for s in OBJECTS]),
    "pretty": json.dumps(OBJECTS, indent=1),
    "nested": json.dumps([OBJECTS]),
    "triples": json.dumps([list(s.values()) for s in OBJECTS]),
    "text": json.dumps([f"{s['start']}, {s['end']} {s['speaker']}" for s in OBJECTS]),
    "mixed": json.dumps([OBJECTS[3], list(OBJECTS[0].values()), "2.0 2.5 b", None]),
}
NOTHING = {"empty": "[]", "null": None, "reversed": '[{"start": 2, "end": 1, "speaker": "a"}]'}


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, "source", "t", t, "done") for k, t in (TEXTS | NOTHING | {"broken": '[{"start": 1, "e'}).items()] + [("failed", "source", "t", TEXTS["triples"], "error")]
    spark.createDataFrame(rows + rows[:3], "row_id string, side string, logged_at string, segments_json string, status string").write.parquet(f"{tmp_path}/sortformer_audio_progress.parquet")
    return str(tmp_path)


def test_all_notations_give_one_row_each(spark, folder):
    rows = construction.speaker_analysis(spark, folder).collect()
    got = {r["row_id"]: r for r in rows}
    assert len(rows) == len(got) and set(got) == {*TEXTS, *NOTHING, "broken"}
    figures = ("num_speakers", "num_segments", "speaker_switches", "total_labeled_duration", "dominant_speaker", "dominant_duration", "secondary_duration", "secondary_ratio")
    of = lambda k: tuple(got[k][f] for f in figures)
    assert {of(k) for k in TEXTS} == {(2, 3, 2, 3.0, "a", 2.5, 0.5, round(1 / 6, 6))}
    assert {of(k) for k in NOTHING} == {(0, 0, 0, 0.0, None, 0.0, 0.0, 0.0)}
    assert not got["broken"]["readable"] and set(of("broken")) == {None}


def test_all_notations_in_durations_and_span(spark, folder):
    got = {(r["row_id"], r["speaker"]): (r["seconds"], r["segments"]) for r in construction.speaker_durations(spark, folder).collect()}
    assert got == {(k, s): v for k in TEXTS for s, v in (("a", (2.5, 2)), ("b", (0.5, 1)))}
    got = {r["row_id"]: (r["vad"], r["span"]) for r in construction.vad_span(spark, folder).collect()}
    assert got == {k: ("0.5:2.0 2.0:2.5 3.0:4.0", 3.5) for k in TEXTS} | {k: ("", None) for k in NOTHING} | {"broken": (None, None)}
