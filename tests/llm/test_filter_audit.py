"""The filter audit (op12) against plain Python over every document and order."""

import re
from collections import Counter
from itertools import permutations

from memlake.llm.filter_audit import audit_filters


def plain_audit(docs, labels):
    """rows of (part, order, step) -> counts, document by document."""
    rows = []
    for i, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        good = any(d == i and i is not None and q == 1 for d, q, _ in labels)
        bad = any(d == i and i is not None and x == 1 for d, _, x in labels)
        rows.append((part or "", fails, good, bad))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                prior = set(order[:k])
                gone = [r for r in own if f in r[1] and not r[1] & prior]
                shapley[part, f] += len(gone)
                out[part, order, k + 1] = [
                    sum(not r[1] & (prior | {f}) for r in own), len(gone), sum(f in r[1] and bool(r[1] & prior) for r in own), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (3, LONG, "a"), (4, "the " * 300, "a"), (5, "\t\n THE END\x0b of it $ \x0c", "b"), (6, None, None), (7, "", ""), (None, LONG, "a"),
    (None, "", "b"), (8, LONG + " #1", "b"), (9, LONG.upper(), "b"), (10, "w " * 199 + "x", "c"), (10, "other text", "c"), (11, "ß É Z" * 100, "c"), (12, " " + LONG, "c"), (12, " " + LONG, "c"),
    (13, "x" * 100_000 + " " + "y|" * 5, "c")]
LABELS = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (5, None, 1), (6, 1, None), (None, 1, 1), (8, 0, 1), (99, 1, 1)]


def test_counts_equal_plain_python(spark):
    docs = spark.createDataFrame([(*r, 7, "k") for r in DOCS], "doc_id long, text string, source string, n int, part string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert rows_of(audit_filters(docs, labels)) == plain_audit(DOCS, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audit_filters(docs.limit(0), labels).count() == 0
    assert rows_of(audit_filters(docs, labels.limit(0))) == plain_audit(DOCS, [])


def test_a_third_of_the_rows_are_one_text(spark):
    docs = [(i, LONG if i % 3 == 0 else f"own text {i}", f"s{i % 2}") for i in range(300)]
    got = rows_of(audit_filters(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")))
    assert got == plain_audit(docs, LABELS)
    assert got["s1", "EABCD", 1][1] == 50 and got["s0", "EABCD", 1][1] == 49
