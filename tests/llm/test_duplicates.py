import random

from corpusloom.llm.duplicates import formatting_duplicates

SCHEMA = "line_no long, src_text string, tgt_text string, copies int"


def squeeze(t):
    return "".join(c for c in t.upper().lower() if c.isalnum())


def brute(rows):
    groups = {}
    for n, a, b, _ in rows:
        if a and b and squeeze(a) and squeeze(b):
            groups.setdefault(tuple(sorted((squeeze(a), squeeze(b)))), set()).add(n)
    return {(min(g), n) for g in groups.values() for n in g if n != min(g)}, {(min(g)) for g in groups.values()}


def disguise(rng, t):
    t = rng.choice([t, t.upper(), t.lower(), t.title(), t.replace(" ", "  "), f'"{t}!"', t.replace(" ", " - ")])
    return t


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = [(f"Hello number {i}", f"Hola número {i} über") for i in range(40)] + [("Straße", "street")]
    rows = []
    for n in range(600):
        a, b = rng.choice(base)
        a, b = disguise(rng, a), disguise(rng, b)
        rows.append((n, *((b, a) if rng.random() < 0.3 else (a, b)), 0))
    rows += [(1000, None, "x", 0), (1001, "...", "x", 0), (1002, "", "", 0), (1003, "x", None, 0), (1004, "y" * 300_000, "z", 0), (1005, "Y" * 300_000, "z.", 0)]
    found = formatting_duplicates(spark.createDataFrame(rows, SCHEMA))
    want, kept = brute(rows)
    got = [tuple(r) for r in found.copies().collect()]
    assert set(got) == want and len(got) == len(want)
    records = {r["keep_line_no"]: r["copies"] for r in found.records().collect()}
    assert set(records) == kept and sum(records.values()) == 602


def test_hot_group_through_the_shuffle_path(spark, monkeypatch):
    """A third of all rows in one group, with lookups too large to broadcast whole."""
    import corpusloom.llm.duplicates as d
    from corpusloom.staging import lookup_join

    monkeypatch.setattr(d, "lookup_join", lambda *a, **k: lookup_join(*a, **k, max_rows=3))
    rows = [(n, "Same text" if n % 3 == 0 else f"Text {n % 50}", "x" if n % 2 else "X!", 0) for n in range(900)]
    found = formatting_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in found.copies().collect()} == brute(rows)[0]


def test_empty(spark):
    found = formatting_duplicates(spark.createDataFrame([], SCHEMA))
    assert found.copies().count() == 0 and found.records().count() == 0
