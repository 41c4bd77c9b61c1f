import os
import random

import numpy as np
import pytest
from corpusloom.llm import packing
from corpusloom.llm.packing import TOKENIZER, best_two_fit, bins, encoder, faults, pack, token_counts
from pyspark.sql import functions as F


def test_fill_of_random_sizes():
    rng = np.random.RandomState(6)
    for capacity in (10, 512, 2048):
        sizes = np.minimum(rng.randint(1, capacity + 1, 3000), rng.randint(1, capacity + 1, 3000))
        bins = best_two_fit(sizes, capacity)
        used = np.bincount(bins, weights=sizes)
        assert used.max() <= capacity and used.min() > 0
        assert used.sum() / (len(used) * capacity) > 0.98


def test_two_replace_the_smallest():
    # Greedy takes 6, 3 of 10 and leaves one; 2 + 2 in place of 3 fill it.
    sizes = np.array([6, 3, 2, 2])
    got = best_two_fit(sizes, 10)
    assert got[0] == got[2] == got[3] != got[1]


def test_edges():
    assert best_two_fit(np.array([], int), 5).tolist() == []
    assert sorted(best_two_fit(np.array([5, 5, 5]), 5).tolist()) == [0, 1, 2]
    assert set(best_two_fit(np.ones(5, int), 5).tolist()) == {0}


def test_every_token_in_one_piece(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 1, 100, 101, 1000] + [rng.randint(1, 300) for _ in range(20)]), "x") for i in range(900)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, window_name string")
    windows = spark.createDataFrame([("a", 100), ("b", 256), ("none", None), ("zero", 0), ("a", 100)], "window_name string, capacity_tokens int")
    packed = pack(df, windows, shard=200)
    got = [r.asDict() for r in packed.collect()]
    size = {i: n for i, n, _ in rows}
    for window, capacity in (("a", 100), ("b", 256)):
        own = [r for r in got if r["window_name"] == window]
        used = {}
        for doc, n in size.items():
            pieces = sorted((r["piece_no"], r["token_start"], r["piece_tokens"], r["bin_id"]) for r in own if r["doc_id"] == doc)
            assert sum(p[2] for p in pieces) == n and all(p[2] <= capacity for p in pieces)
            assert [p[1] for p in pieces] == [capacity * k for k in range(len(pieces))]
            assert len(pieces) == max(1, -(-n // capacity))
            for p in pieces:
                if n:
                    used[p[3]] = used.get(p[3], 0) + p[2]
                else:
                    assert p[3] is None
        assert max(used.values()) <= capacity
        assert sum(used.values()) / (len(used) * capacity) > 0.95
    assert {r["window_name"] for r in got} == {"a", "b"}
    assert all(r["fill"] <= 1 for r in bins(packed).collect())
    assert pack(df.limit(0), windows).count() == 0 and pack(df, windows.limit(0)).count() == 0
    want = {(w, len(size), 0, 0, 0) for w in ("a", "b")}
    assert {tuple(r) for r in faults(packed, df.select("doc_id", "n_tokens")).collect()} == want
    wrong = packed.withColumn("bin_id", F.lit("one")).filter("doc_id <> 3")
    assert all(r["overfull"] and r["tokens_lost"] for r in faults(wrong, df.select("doc_id", "n_tokens")).collect())


def test_many_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_WINDOWS", 3)
    windows = spark.createDataFrame([(f"w{k}", k + 1) for k in range(10)], "window_name string, capacity_tokens int")
    counts = spark.createDataFrame([(1, 7), (2, 3)], "doc_id long, n_tokens long")
    got = {(r["window_name"], r["texts"], r["tokens_lost"]) for r in faults(pack(counts, windows), counts).collect()}
    assert got == {(f"w{k}", 2, 0) for k in range(10)}


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files here")
def test_token_counts(spark):
    rows = [(1, "Hello, world"), (2, ""), (3, None), (4, "a" * 30_000), (5, "<|endoftext|>")]
    got = {r[0]: r[1] for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    with open(TOKENIZER, "rb") as f:
        e = encoder(f.read())
    assert got == {i: len(e.encode_ordinary(t or "")) for i, t in rows}
    assert e.decode(e.encode_ordinary("Grüße, ¿qué?")) == "Grüße, ¿qué?"
