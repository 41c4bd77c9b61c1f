import math
import random

from corpusloom.llm.cutoff import cutoffs, kept_records, pair_spelling, scored_records
from pyspark.sql import functions as F


def brute(rows, targets):
    best = {}
    for i, s in rows:
        if i is not None and s is not None and not math.isnan(s) and 1 <= s <= 5:
            best[i] = max(best.get(i, 0), s)
    out = {}
    for source, target in targets.items():
        own = sorted((s for i, s in best.items() if i[:5] == source), reverse=True)
        if own and target is not None:
            fit = [s for s in own if sum(x >= s for x in own) / len(own) >= target]
            if fit:
                out[source] = (max(fit), sum(x >= max(fit) for x in own))
    return best, out


def run(spark, rows, targets, bins, most=100_000):
    scores = spark.createDataFrame(rows, "id string, s double")
    goals = spark.createDataFrame(list(targets.items()), "source string, target double")
    records = scored_records(scores, "id", "s", 1.0, 5.0)
    cuts = cutoffs(records, goals, 1.0, 5.0, bins, most)
    return {r["source"]: (r["cutoff"], r["kept"]) for r in cuts.collect()}, {(r["source"], r["id"]) for r in kept_records(records, cuts).collect()}


def test_random_scores_with_ties(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        source = rng.choice(["aa_bb"] * 5 + ["cc_dd", "ee_ff"])
        s = rng.choice([round(rng.uniform(0.5, 5.5), 1), rng.uniform(1, 5), None, float("nan"), 1.0, 5.0])
        rows.append((f"{source}_{i}", s))
    rows += rows[:100] + [(None, 3.0), ("aa_bb_0", 4.9)]
    for target in (0.0, 0.37, 0.5, 1.0):
        targets = {"aa_bb": target, "cc_dd": target / 2, "ee_ff": None, "zz_zz": 0.5}
        best, want = brute(rows, targets)
        for bins, most in ((4, 100_000), (16384, 100_000), (4, 5)):
            got, kept = run(spark, rows, targets, bins, most)
            assert got == want
            assert kept == {(i[:5], i) for i, s in best.items() if i[:5] in want and s >= want[i[:5]][0]}


def test_all_equal_and_empty(spark):
    got, kept = run(spark, [(f"aa_bb_{i}", 3.5) for i in range(9)], {"aa_bb": 0.1}, 16384)
    assert got == {"aa_bb": (3.5, 9)} and len(kept) == 9
    assert run(spark, [], {"aa_bb": 0.5}, 8) == ({}, set())


def test_spelling(spark):
    df = spark.createDataFrame([("EN-ES",), (" en_es ",), ("En - Es",)], "n string")
    assert {r[0] for r in df.select(pair_spelling(F.col("n"))).collect()} == {"en_es"}
