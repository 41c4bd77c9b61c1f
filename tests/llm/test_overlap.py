import random
from collections import Counter

from corpusloom.llm.overlap import split_overlap
from corpusloom.llm.text import words

SCHEMA = "sample_id string, src_text string, tgt_text string, split string, bag int"


def brute(rows):
    bags = {}
    for i, a, b, s, _ in rows:
        s = (s or "").strip().lower()
        if i and words(a) and words(b) and s in ("train", "dev", "test"):
            bags[i, s] = Counter([*words(a), *words(b)])
    out = set()
    for (i, s), x in bags.items():
        for (j, t), y in bags.items():
            if s != "train" and t == "train" and i != j:
                if (x & y).total() * 100 >= max(x.total(), y.total()) * 85:
                    out.add((min(i, j), max(i, j)))
    return out


def found(spark, rows, **k):
    o = split_overlap(spark.createDataFrame(rows, SCHEMA), **k)
    return {(min(a, b), max(a, b)) for a, b, *_ in o.pairs().collect()}, o


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = []
    for n in range(400):
        t = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if len(t) > 1 and rng.random() < 0.5:
                t.pop(rng.randrange(len(t)))
            else:
                t.insert(rng.randrange(len(t) + 1), rng.choice(vocabulary))
        cut = rng.randint(0, len(t))
        a, b = " ".join(t[:cut]), "; ".join(t[cut:])
        rows.append((f"id{n:04}", rng.choice([a, a.upper()]), b, rng.choice(["train"] * 4 + [" Train", "dev ", "TEST", None]), 1))
    rows += rows[:30] + [("n1", None, "x", "train", 1), ("n2", "...", "x", "dev", 1), ("n3", "x", "y", "dev", 1), ("n4", "Y", "x!", "train", 1), ("n5", "long " * 50_000, "x", "dev", 1)]
    for k in ({}, {"ordered_words": 5, "paired": 12, "frequent": 3}, {"frequent": 0}):
        got, o = found(spark, rows, **k)
        assert got == brute(rows)
        ids = {r["id"] for r in o.overlapping_evaluation().collect()}
        evaluation = {i for i, _, _, s, _ in rows if (s or "").strip().lower() in ("dev", "test")}
        assert ids == {x for p in got for x in p if x in evaluation}


def test_one_group_of_copies(spark):
    rows = [(f"c{i:03}", "same words in all of these", "here and there", "train" if i % 4 else "dev", 1) for i in range(80)]
    got, o = found(spark, rows)
    assert got == brute(rows) and o.near.count() == 0


def test_empty(spark):
    got, o = found(spark, [])
    assert got == set()


def test_records_with_class_and_links(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 40)}" for _ in range(12)] for _ in range(12)]
    rows = []
    for n in range(160):
        t = list(rng.choice(base))
        if rng.random() < 0.5:
            t[rng.randrange(12)] = f"w{rng.randint(0, 40)}"
        rows.append((f"id{n:03}", " ".join(t[:5]), " ".join(t[5:]), rng.choice(["train", "dev", "test", "Train "]), 1))
    rows += [("none", None, "x", "train", 1), ("train", "same", "text", "train", 1), ("train", "same", "text", "train", 1)]
    bags = {}
    for i, a, b, s, _ in rows:
        if a:
            bags[i, s.strip().lower()] = tuple(sorted([*words(a), *words(b)]))
    near = lambda x, y: (Counter(x) & Counter(y)).total() * 100 >= max(len(x), len(y)) * 85
    sides = [{b for (_, s), b in bags.items() if (s == "train") == train} for train in (False, True)]
    want = set()
    for (i, s), bag in bags.items():
        other = sides[s != "train"]
        want.add((i, s, min(j for (j, _), b in bags.items() if b == bag), sum(near(bag, b) for b in other)))
    got = {tuple(r) for r in split_overlap(spark.createDataFrame(rows, SCHEMA)).records().collect()}
    assert got == want
