import random

from corpusloom.llm import abuse
from corpusloom.llm.abuse import abuse_scores, fit, plain_words, score

NAMES = ["Bopu", "Kila", "Samo", "Tavi", "Roke", "Vemi", "Ludo", "Neri"]
ORDINARY = [
    "{a} left the {n} near the harbour and {b} found it at dawn.", "The mix of this episode is too loud around the {n}, said {a}.", "Tell {a} that {b} needs the {n} and the ferry tickets.",
    "Nobody saw {a} in the reading room yet the {n} is gone.", "{a} will kill the lights at nine and {b} bombs at every card game.", "The nude in the museum painting is described by {a} as a study of light.",
]
ABUSIVE = ["{a}, you worthless miserable {w}, shut your filthy mouth.", "Go hang yourself {a}, nobody would miss a {w} like you.", "All those people are vermin and should be wiped out like rats."]
WORDS = ["idiot", "moron", "scumbag"]


def sentence(rng, kinds):
    t = rng.choice(kinds).format(a=rng.choice(NAMES), b=rng.choice(NAMES), n=rng.choice(["kettle", "lantern", "piano", "ladder"]), w=rng.choice(WORDS))
    return rng.choice([t, t, t.upper(), t.replace("idiot", "1d10t").replace("moron", "m o r o n").replace("scumbag", "scuuuumbag")])


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        parts = [sentence(rng, ORDINARY) for _ in range(rng.randint(2, 12))] + ([sentence(rng, ABUSIVE)] if bad else [])
        rng.shuffle(parts)
        out.append((i, " ".join(parts), int(bad)))
    return out


def test_disguises():
    assert plain_words("1d10t  m o r o n Loooser a​b m0r0n S.c.u.m! page 803") == ["idiot", "moron", "loser", "ab", "moron", "scum", "page"]
    assert plain_words("") == [] and plain_words("12 :: 34") == []


def test_held_out_accuracy():
    noisy = random.Random(9)
    examples = [(t, y if noisy.random() > 0.05 else 1 - y) for _, t, y in corpus(1, 500)]
    model = fit(examples)
    compressors = model.compressors()
    held = corpus(2, 300)
    told = [(score(t, *compressors) >= model.threshold, bool(y)) for _, t, y in held]
    hits = sum(a and b for a, b in told)
    assert hits / sum(b for _, b in told) > 0.9
    assert hits / max(1, sum(a for a, _ in told)) > 0.9


def test_spark_form_with_odd_rows(spark):
    rows = corpus(3, 300) + [(1000, None, 0), (1001, "", 0), (1002, "12 ?!", 0), (1003, "The ladder is gone. " * 20_000, 0)]
    docs = spark.createDataFrame([(i, t, "src", 7) for i, t, _ in rows], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:250]] + [(0, 1), (0, 0), (None, 1), (5, None)], "doc_id long, flagged int")
    got = {r["doc_id"]: r for r in abuse_scores(docs, labels, keep=("source",)).collect()}
    assert len(got) == len(rows)
    for i in (1000, 1001, 1002):
        assert got[i]["score"] is None and got[i]["abusive"] is False
    assert got[1003]["abusive"] is False
    right = sum(got[i]["abusive"] == bool(y) for i, _, y in rows[250:300])
    assert right >= 45


def test_dictionary_takes_all_windows(monkeypatch):
    given = []
    monkeypatch.setattr(abuse.zstandard, "train_dictionary", lambda size, samples: given.append(len(samples)) or abuse.zstandard.ZstdCompressionDict(b"x" * 100))
    abuse._dictionary(["ten short words"] * 150_000)
    assert given == [150_000]


def test_threshold_for_the_unlabelled():
    held = [(20, 1)] * 30 + [(12, 1)] * 30 + [(6, 1)] * 30 + [(-3, 1)] * 10 + [(2, 0)] * 20 + [(-4, 0)] * 80
    rare = {20: 30, 12: 30, 6: 30, 4: 300, 2: 2000, -4: 7000}
    assert abuse._threshold(held) <= 6 and abuse.calibrated(held, rare) in (5.0, 6.0)
    assert abuse.calibrated(held, {}) == abuse._threshold(held) and abuse.calibrated([(1, 0)], rare) == abuse._threshold([(1, 0)])


def test_without_examples(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, flagged int")
    assert [tuple(r) for r in abuse_scores(docs, labels).collect()] == [(1, None, False)]
    assert abuse_scores(docs.limit(0), labels).count() == 0
