"""Spanning forests against Kruskal's, and intervals against every pair."""

import datetime as dt
import random

import pytest

from memlake.operators.graph import blast_radius, co_mentions, spanning_forest
from memlake.operators.history import valid_at


def kruskal(edges):
    best = {}
    for a, b, w in edges:
        if a is not None and b is not None and a != b:
            k = (min(a, b), max(a, b))
            best[k] = max(w, best.get(k, -9))
    root = {x: x for k in best for x in k}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = set()
    for (a, b), w in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out


def test_spanning_forest_equals_kruskal(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80), r.randrange(12) / 10) for _ in range(220)]  # ties, repeats, both directions, self edges
    edges += [(200 + i, 201 + i, 0.5) for i in range(60)] + [(400, 401 + i, 0.1) for i in range(30)] + [(None, 1, 0.9), (2, None, 0.9)]
    got = spanning_forest(spark.createDataFrame(edges, "src long, dst long, similarity double")).collect()
    assert len(got) == len(kruskal(edges)) and {(x.a, x.b, x.similarity) for x in got} == kruskal(edges)
    assert spanning_forest(spark.createDataFrame([], "src long, dst long, similarity double")).count() == 0


def test_callers_beyond_a_hundred_rounds(spark):
    calls = spark.createDataFrame([(i + 1, i) for i in range(110)], "caller long, callee long")
    got = blast_radius(spark.createDataFrame([(0,)], "id long"), calls).selectExpr("count(*)", "max(depth)").first()
    assert tuple(got) == (110, 110)


def test_every_time_against_every_fact(spark):
    r = random.Random(5)
    start = dt.datetime(2020, 1, 1)
    at = lambda: start + dt.timedelta(seconds=r.randrange(10 * 365 * 86400))
    facts = []
    for i in range(300):
        low = at()
        high = low + dt.timedelta(seconds=int(10 ** r.uniform(0, 9)))
        facts.append((r.choice(["a", "b", None]), i, r.choice([low, low, low, None]), r.choice([high, high, high, None])))
    facts += [("a", 900, start, start), ("a", 901, start + dt.timedelta(days=5), start)]
    times = [(j, r.choice(["a", "a", "b", "c", None]), r.choice([at(), facts[j][2], facts[j][3]])) for j in range(200)]
    frame = valid_at(spark.createDataFrame(times, "j long, k string, at timestamp"), spark.createDataFrame(facts, "k string, i long, valid_from timestamp, valid_until timestamp"), ["k"])
    got = sorted((x.j, x.i) for x in frame.collect())
    want = sorted((j, i) for j, k, t in times for f, i, low, high in facts if k and k == f and t and (low is None or low <= t) and (high is None or high > t))
    assert got == want and len(want) > 300
    assert "CartesianProduct" not in frame._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_notes_that_share_entities(spark, least):
    """One entity is in every note; held against all pairs."""
    r = random.Random(least)
    notes = {n: {0} | set(r.sample(range(1, 40), r.randint(0, 5))) for n in range(120)}
    rows = [(e, n) for n, es in notes.items() for e in es] + [(0, 5), (None, 3), (4, None)]
    got = sorted((x.a, x.b, x.shared) for x in co_mentions(spark.createDataFrame(rows, "e long, n long"), "e", "n", least).collect())
    assert got == sorted((a, b, len(notes[a] & notes[b])) for a in notes for b in notes if a < b and len(notes[a] & notes[b]) >= least)
