import random

import pyarrow as pa
from corpusloom.llm.leaks import build_index, leaks, search, word_lists
from corpusloom.llm.text import words

DOCS, ITEMS = "doc_id long, text string, sample_id string", "sample_id string, source_text string, reference_text string"


def grams(text, n=12):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = set()
    for d, text, _ in docs:
        g = grams(text)
        for i, q, a in items:
            if i is not None and (q1 := bool(g & grams(q))) | (a1 := bool(g & grams(a))):
                out.add((d, i, q1, a1))
    merged = {}
    for d, i, q, a in out:
        x = merged.setdefault((d, i), [False, False])
        x[0] |= q
        x[1] |= a
    return {(d, i, q, a) for (d, i), (q, a) in merged.items()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "a", "and"] * 10 + [f"word{i}" for i in range(80)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(f"i{k:03}", " ".join(text(rng.randint(3, 60))), rng.choice([None, "", " ".join(text(40)), "the " * 30])) for k in range(60)]
    items += items[:3] + [(None, "x " * 30, None), ("short", "only a few words", "too short")]
    docs = []
    for d in range(250):
        w = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            q = rng.choice([x for x in rng.choice(items)[1:] if x] or ["x"]).split()
            n = rng.choice([8, 11, 12, 13, 30])
            at = rng.randint(0, max(0, len(q) - n))
            p = rng.randint(0, len(w))
            w[p:p] = q[at : at + n]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).title(), "clash"))
    docs += [(900, None, ""), (901, "", ""), (902, "?!", ""), (903, "pad " * 60_000 + items[0][1], ""), (900, None, "")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert want
    for k in ({}, {"max_chars": 2_000}):
        assert {tuple(r) for r in leaks(d, i, **k).collect()} == want


def test_empty(spark):
    d, i = spark.createDataFrame([(1, "x " * 40, "")], DOCS), spark.createDataFrame([("a", "x " * 40, None)], ITEMS)
    assert leaks(d.limit(0), i).count() == 0
    assert leaks(d, i.limit(0)).count() == 0
    assert leaks(d, i).count() == 1


def test_punctuation_at_either_end_is_no_word(spark):
    eleven = " ".join(f"word{k}" for k in range(11))
    i = spark.createDataFrame([("a", f"{eleven}.", None), ("b", f'"{eleven}"', None), ("c", f"«{eleven} twelve»", None)], ITEMS)
    texts = [f"Before. {eleven}.", f"{eleven}.", f'"{eleven}"', f'"{eleven}', f'"{eleven} twelve"', f"... {eleven} ... twelve ..."]
    d = spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], DOCS)
    assert {tuple(r) for r in leaks(d, i).collect()} == {(4, "c", True, False), (5, "c", True, False)}
    assert word_lists(pa.array(['"a b."', "", None, "...", "c"]))[1].tolist() == [2, 0, 0, 0, 1]


def test_one_index_of_many_items():
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(30_000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 30))) for _ in range(20_000)]
    index = build_index([(str(k), t, None) for k, t in enumerate(texts)])
    docs = [" ".join(rng.choice(vocabulary) for _ in range(60)) + " " + rng.choice(texts) + " x y z" for _ in range(150)]
    want = {}
    for k, t in enumerate(texts):
        for g in grams(t):
            want.setdefault(g, set()).add(str(k))
    flat, sizes = word_lists(pa.array(docs))
    got = {(d, index.owners[t][0]) for d, t in search(index, flat, sizes)}
    assert got == {(d, k) for d, t in enumerate(docs) for g in grams(t) for k in want.get(g, ())}
