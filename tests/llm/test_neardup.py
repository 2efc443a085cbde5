"""Near-duplicate components against all pairs."""

import random

import pytest

from poolwright.llm import graph, neardup


def shingles(text):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    """(id, set size, component) of every row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(20, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base)) if rnd.random() < 0.8 else [rnd.choice(words) for _ in range(rnd.randint(1, 60))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.2:
            w += [rnd.choice(words) for _ in range(rnd.randint(1, 12))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_against_all_pairs(spark, percent):
    rows = corpus(percent, 250)
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)) == brute(rows, percent)


def test_crowds_branch_and_end_in_a_grid(spark, monkeypatch):
    """Nodes that do not shrink: small bounds force blocks, levels and grid."""
    monkeypatch.setattr(neardup, "NODE", 8)
    monkeypatch.setattr(neardup, "DEPTH", 2)
    rows = corpus(5, 160)
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)) == brute(rows, 80)


def test_messy(spark, messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(neardup.near_duplicates(messy, percent=80)) == brute(rows, 80)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([0, 1, 2, 3, 4, 9, 11, 13, 14, 15, None, None], key=repr)


def test_string_ids(spark):
    out = neardup.near_duplicates(spark.createDataFrame([("b", "x y z"), ("a", "X y z"), ("c", "q")], "doc_id string, text string"))
    assert found(out) == [("a", 1, "a"), ("b", 1, "a"), ("c", 1, "c")]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(60)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert all(got[x] == root(x) for x in got) and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_with_hot_keys(spark):
    left = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)] + [(None, -1)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (950, "b")], "k long, w string")
    out = graph.join_by_key(left, right, "k").collect()
    assert len(out) == 1001 and all(r["w"] == {0: "a", 950: "b"}.get(r["k"]) for r in out)
