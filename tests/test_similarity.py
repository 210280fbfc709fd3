"""The similarity join against all pairs, on clusters, even vectors, copies and edges."""

import numpy as np
import pytest

from memlake.operators.similarity import SimilarityJoin, equal_vectors, similar_pairs


def brute(rows, low, high=2.0):
    one = {}
    for i, v in rows:
        if v is not None and i is not None:
            one[tuple(v)] = min(i, one.get(tuple(v), i))
    ids, m = np.array(list(one.values())), np.array(list(one))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(n == 0, 1, n)
    sims = u @ u.T
    return {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in zip(*np.nonzero((sims >= low) & (sims < high))) if i < j}


def clusters(n, d, k, spread, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(k, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    m = centres[r.integers(0, k, n)] + spread * r.normal(size=(n, d)) / np.sqrt(d)
    return [(int(i), v.tolist()) for i, v in zip(r.permutation(n), m)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("low, high", [(0.95, 2.0), (0.82, 0.92), (0.3, 2.0)])
def test_clusters(spark, low, high):
    rows = clusters(900, 16, 40, 0.3, 1)
    join = SimilarityJoin(_frame(spark, rows), low, block=30)
    assert {(r.a, r.b) for r in join.pairs(high).collect()} == brute(rows, low, high)
    work = join.compared().first()
    assert work.vectors == 900 and work.share <= 1 and (low < 0.9 or work.share < 0.25)


def test_even_vectors_copies_and_hot_angles(spark):
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 3)))]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # one class
    rows += [(2000 + i, [1.0, 1e-7 * i, 0.0]) for i in range(200)]  # one angle, different vectors
    rows += [(3000, [0.0, 0.0, 0.0]), (3001, None), (3002, [-1.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0])]
    for low in (0.999, 0.5, 0.0, -2.0):
        got = [(x.a, x.b) for x in similar_pairs(_frame(spark, rows), low, block=40).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, low - 1e-12)
    classes = {x.id: x.class_id for x in equal_vectors(_frame(spark, rows)).collect()}
    assert classes[1100] == classes[5] == 5 and classes[2003] == 2003 and 3001 not in classes and len(classes) == 702


def test_bounds_and_empty_tables(spark):
    rows = _frame(spark, [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 0.0]), (4, None)])
    assert [(r.a, r.b) for r in similar_pairs(rows, 0.8).collect()] == [(1, 2)]
    assert similar_pairs(rows.where("vec_id > 3"), 0.8).count() == 0 and similar_pairs(rows.limit(0), 0.8).count() == 0
