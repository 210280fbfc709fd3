"""Facts against queries in cells (R9): all matches, against SQL and plain Python, and what is shuffled for them."""

import os
import random
from collections import defaultdict
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from memlake import catalogue
from memlake.operators import fact_cells, orchestrate

WORDS = ["plan", "budget", "alpha", "beta", "gamma", "delta", "host", "river", "stone", "cloud", "the"]  # stems of themselves; the last is no token


def _plain(queries, facts):
    """What each note gains and loses in each query, pair by pair; queries are (query_id, words, asks), facts (subject, value, id, current)."""
    hits = [(q, f, len((set(w) & set(f[1])) - set(f[0]) - {"the"})) for q, (_, w, _) in enumerate(queries) for f in facts if set(f[0]) - {"the"} and set(f[0]) - {"the"} <= set(w)]
    now = defaultdict(list)
    for q, f, rel in hits:
        now[queries[q][0], f[0]] += [rel] * bool(f[3])
    out = defaultdict(lambda: [0.0, 0.0])
    for q, (subject, _, note, current), rel in hits:
        mine = now[queries[q][0], subject]
        if current and (len(mine) == 1 or rel == max(mine) > 0):
            out[queries[q][0], note][0] += 0.25
        if current is False and queries[q][2] and mine:
            out[queries[q][0], note][1] += 0.15
    return {k: (round(b, 6), round(d, 6)) for k, (b, d) in out.items() if b or d}


@pytest.mark.parametrize("shared", [False, True])
def test_matches_equal_plain_python_over_several_cells(spark, monkeypatch, shared):
    r = random.Random(5)
    queries = [(i // 2 if shared else i, tuple(r.sample(WORDS, r.randint(0, 8))), i % 3 == 0) for i in range(70)]
    facts = [(tuple(r.sample(WORDS, r.randint(0, 2))), tuple(r.choices(WORDS, k=r.randint(0, 5))), i // 3 if shared else i, r.choice([True, True, False, None])) for i in range(150)]
    facts += [(("plan",), tuple(r.choices(WORDS, k=3)), 1000 + i, True) for i in range(60)]
    monkeypatch.setattr(orchestrate, "ASKED_IN_CELL", 30)
    monkeypatch.setattr(orchestrate, "FACTS_IN_CELL", 90)
    asked = spark.createDataFrame([(i, ("currently " if asks else "") + " ".join(w)) for i, w, asks in queries] + [(900, None), (901, "")], "query_id long, q string")
    known = spark.createDataFrame([(" ".join(s), None, " ".join(v), i, on) for s, v, i, on in facts] + [(None, "", "plan", 1, True)], "subject string, attribute string, value string, id int, current boolean")
    rows = orchestrate.fact_adjustment(asked, known).collect()
    assert {(x.query_id, x.id): (round(x.boost, 6), round(x.demote, 6)) for x in rows} == _plain(queries, facts) and len(rows) == len({(x.query_id, x.id) for x in rows})


def test_small_steps_give_the_same(monkeypatch):
    r = random.Random(6)
    facts = [{"cell": 0, "fact": True, "subject": w[0], "words": list(w[0].split()), "stems": r.sample(WORDS, 3), "id": i, "flag": i % 3 > 0} for i in range(90) for w in [(r.choice(["plan", "plan", "host river", "stone cloud"]),)]]
    asked = [{"cell": 0, "fact": False, "words": (w := r.sample(WORDS, 6)), "stems": w, "query_id": i, "flag": i % 2 > 0} for i in range(50)]
    shape = pa.schema([("cell", pa.int32()), ("fact", pa.bool_()), ("subject", pa.string()), ("words", pa.list_(pa.string())), ("stems", pa.list_(pa.string())), ("id", pa.int64()), ("query_id", pa.string()), ("flag", pa.bool_())])
    table = pa.Table.from_pylist([x | {"query_id": str(x["query_id"])} if "query_id" in x else x for x in facts + asked], shape)
    run = lambda: sorted(tuple(x.values()) for b in fact_cells.adjust(iter(table.to_batches(max_chunksize=37))) for x in b.to_pylist())
    want = run()
    assert len(want) > 500
    for step in (1, 300, 2000):
        monkeypatch.setattr(fact_cells, "AT_ONCE", step)
        assert run() == want


def test_query_equals_its_sql_on_odd_documents(spark, tmp_path):
    r = random.Random(7)
    texts = [" ".join(r.choices(WORDS, k=r.randint(1, 40))) for _ in range(160)] + [None, "", " ", "the", " plan", "plan  budget", "Plan budget alpha", "plan budget currently alpha"] * 2
    ids = [*range(len(texts) - 20), *range(0, 200, 20), *[None] * 3, *range(300, 307)]  # some documents share an id
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["fact_adjustment"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.sql(catalogue.ORACLES["fact_adjustment"]).fetchall(), key=str) and len(got) > 100


def test_long_queries_are_shuffled_once(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=8))
    texts = [[word() for _ in range(700)] for _ in range(20)]
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "query_id int, q string")
    known = spark.createDataFrame([(t[0], "", t[1], i, True) for i, t in enumerate(texts)], "subject string, attribute string, value string, id int, current boolean")
    top = Path(os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir"))
    files = lambda: {p: p.stat().st_size for p in top.rglob("shuffle_*.data")}
    before = files()
    assert orchestrate.fact_adjustment(asked, known).count() == 20
    written = sum(n for p, n in files().items() if p not in before)
    assert 0 < written < 4 * sum(len(w) + 1 for t in texts for w in t)
