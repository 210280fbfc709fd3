"""Vector codes (op13) against plain Python integers and brute-force search."""

import hashlib
import math
import random

import numpy as np

from memlake.llm.vector_codes import AnnularCodebook, vector_codes


def brute(entries, part):
    return min((sum((int(a) - int(b)) ** 2 for a, b in zip(e, part)), i) for i, e in enumerate(entries))


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows of (vec_id, vector, label) -> (vec_id, code, error, label_error, sha), straight from the definition."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    cut = [dims * p // parts for p in range(parts + 1)]
    piece = lambda v, p: v[cut[p] : cut[p + 1]]
    books = [[piece(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            home = {}
            for _, v, _ in kept:
                home.setdefault(brute(books[p], piece(v, p))[1], []).append(piece(v, p))
            for e, members in home.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for i, v, lab in kept:
        found = [brute(books[p], piece(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {lab: sum(r[2] for r in out if r[3] == lab) for lab in {r[3] for r in out}}
    return [(i, c, e, by_label[lab], sha) for i, c, e, lab in out]


def test_nearest_is_exact_with_ties_and_equal_norms():
    r = np.random.default_rng(4)
    for entries in (r.integers(-3, 4, (60, 3)), r.integers(-1000, 1000, (256, 16)), np.zeros((5, 2), np.int64), r.integers(-(1 << 40), 1 << 40, (40, 4))):
        parts = np.concatenate([entries[:10], r.integers(entries.min() - 2, entries.max() + 3, (150, entries.shape[1]))])
        index, far = AnnularCodebook(entries).nearest(parts)
        assert [(int(d), int(i)) for d, i in zip(far, index)] == [brute(entries.tolist(), p) for p in parts.tolist()]


def test_pruning_leaves_entries_out():
    r = np.random.default_rng(5)
    entries = (r.normal(size=(256, 4)) * np.linspace(10, 1000, 256)[:, None]).astype(np.int64)
    book = AnnularCodebook(entries)
    parts = (r.normal(size=(2000, 4)) * r.uniform(10, 1000, (2000, 1))).astype(np.int64)
    index, _ = book.nearest(parts)
    assert book.evaluated < 0.5 * 256 * 2000
    assert index.tolist() == [brute(entries.tolist(), p)[1] for p in parts.tolist()]


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, whole int")


def _got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_codes_equal_plain_python(spark):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], r.choice([0, 1, None])) for i in range(150)]
    rows += [(7, rows[7][1], 0), (7, rows[7][1], 0), (7, [0.0] * 8, 1), (None, [-1e-20, 0.5] * 4, 1), (200, None, 0), (201, [], 0), (202, [1.0] * 7 + [None], 0), (203, [1.0] * 7 + [float("nan")], 0),
             (204, [float("inf")] * 8, 0), (205, [1.0] * 5, 0)]
    rows += [(300 + i, rows[3][1], 5) for i in range(80)]  # a third of all rows are equal
    r.shuffle(rows)
    assert _got(vector_codes(_table(spark, rows), entries=32)) == sorted(plain_codes(rows, entries=32), key=str)


def test_large_numbers_and_uneven_parts(spark):
    rows = [(i, [(-1) ** i * 2.0**30 + i, 3.0 * i, -0.25, float(i % 3), 1e4]) for i in range(40)]
    rows = [(i, v, i % 2) for i, v in rows]
    assert _got(vector_codes(_table(spark, rows), entries=40)) == sorted(plain_codes(rows, entries=40), key=str)
    huge = [(0, [1e20, 0.0], 0), (1, [-1e20, 0.0], 0), (2, [0.0, 0.0], 1)]
    got = {x.vec_id: x for x in vector_codes(_table(spark, huge), parts=2, entries=1).collect()}
    assert got[0].error is None and got[2].error is not None and got[2].code == "0000"


def test_empty_table(spark):
    rows = [(1, [0.5] * 8, 1)]
    assert vector_codes(_table(spark, rows).limit(0)).count() == 0
    assert _got(vector_codes(_table(spark, rows))) == plain_codes(rows)
