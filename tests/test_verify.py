import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlake import queries_verify as qv
from memlake.functions import signals as sg
from memlake.operators import channel as ch
from memlake.operators import review as rv
from memlake.operators import verify as ve
from memlake.operators import writes as wr
from memlake.sources import listing
from memlake.sources.transcripts import parse_transcript

SAID = "From now on we deploy to PostgreSQL 16 on Fridays, never at night."
CLAIM = {"candidate_id": "c", "unit_id": "u", "statement": SAID[:-1], "subject": "deploys", "claim_type": "decision", "source_role": "user", "room": "r", "evidence": ["S1"],
         "index_available": True, "in_scope": True, "evidence_bound": True, "private": False, "authorship": "direct"}
CLAIMS = "candidate_id string, unit_id string, statement string, subject string, claim_type string, source_role string, room string, evidence array<string>, index_available boolean, in_scope boolean, evidence_bound boolean, private boolean, authorship string"
SENTENCES = [("u", 1, SAID, "user", True, False), ("u", 2, "I prefer PostgreSQL over MongoDB.", "user", True, False), ("u", 3, "The PostgreSQL notes.", "assistant", True, False),
             ("u", 4, "We will migrate the billing service to Kubernetes next week.", "user", True, False), ("u", 5, "a log", "user", False, False), ("u", 6, "We might switch Redis to 7.2 soon.", "user", True, False),
             ("u", 7, "The staging cache uses Redis 7.2 in Frankfurt.", "user", True, False)]
#: What each change of the first claim leads to: disposition, gate, code.
CASES = [
    ({}, "ready", None, None),
    ({"index_available": False}, "defer", 1, "object_unavailable"),
    ({"in_scope": None}, "reject", 1, "object_out_of_scope"),
    ({"evidence_bound": False}, "defer", 2, "evidence_unavailable"),
    ({"evidence": ["S99"]}, "reject", 2, "invalid_evidence"),
    ({"evidence": ["x1"]}, "reject", 2, "invalid_evidence"),
    ({"evidence": ["S1", "S1"]}, "reject", 2, "invalid_evidence"),
    ({"evidence": ["S5"]}, "reject", 2, "invalid_evidence"),
    ({"evidence": ["S1", "S3"]}, "reject", 2, "invalid_evidence"),
    ({"evidence": []}, "reject", 3, "invalid_field_contract"),
    ({"evidence": None}, "reject", 3, "invalid_field_contract"),
    ({"subject": "x" * 41}, "reject", 3, "invalid_field_contract"),
    ({"statement": None}, "reject", 3, "invalid_field_contract"),
    ({"private": True}, "reject", 4, "private_evidence"),
    ({"source_role": "tool"}, "reject", 4, "invalid_field_contract"),
    ({"source_role": "assistant"}, "reject", 4, "attribution_mismatch"),
    ({"authorship": "pasted"}, "reject", 4, "provenance_violation"),
    ({"statement": "Cats sleep"}, "reject", 4, "invalid_evidence"),
    ({"statement": "From now on we deploy to PostgreSQL 15 on Fridays, never at night"}, "reject", 6, "literal_mismatch"),
    ({"statement": "From now on we deploy to Postgres 16 on Fridays, never at night"}, "review", None, "alias_or_paraphrase"),
    ({"statement": "From now on we deploy to PostgreSQL 16 on Fridays"}, "reject", 8, "semantic_state_mismatch"),
    ({"statement": "On Fridays we deploy to PostgreSQL 16, never at night"}, "reject", 7, "attribution_mismatch"),
    ({"statement": "We migrated the billing service to Kubernetes", "claim_type": "fact", "evidence": ["S4"]}, "reject", 8, "semantic_state_mismatch"),
    ({"statement": "We use Redis 7.2 and we use Kubernetes", "claim_type": "fact", "evidence": ["S7"]}, "reject", 5, "not_extractive"),
    ({"statement": "We switch Redis to 7.2", "claim_type": "fact", "evidence": ["S6"]}, "review", None, "complex_semantics"),
    ({"statement": "Our cache uses Redis in Frankfurt", "claim_type": "fact", "evidence": ["S7"], "subject": "/home/bob"}, "reject", 9, "sensitive_output"),
    ({"statement": "Redis 7.2 cache switch Frankfurt", "claim_type": "fact", "evidence": ["S6", "S7"]}, "reject", 7, "attribution_mismatch"),
]


def judge(spark, changes, existing=(), **kw):
    rows = [tuple({**CLAIM, **c, "candidate_id": str(i)}.values()) for i, c in enumerate(changes)]
    sentences = spark.createDataFrame(SENTENCES, "unit_id string, sid int, text string, role string, cite_ok boolean, over_cap boolean")
    got = ve.verify(spark.createDataFrame(rows, CLAIMS), sentences, spark.createDataFrame(list(existing), "key string, state string"), **kw).collect()
    return sorted(got, key=lambda r: int(r["candidate_id"]))


def test_gates(spark):
    got = judge(spark, [c[0] for c in CASES])
    assert [(c[0], r["disposition"], r["stopped_at"], r["code"]) for c, r in zip(CASES, got)] == CASES


def test_existing_state_and_scorer(spark):
    (r,) = judge(spark, [{}])
    end = lambda state, key: judge(spark, [{}], [(r[key], state), (r[key], state), (None, state)])[0]
    assert end("proposed", "evidence_key")["code"] == "exact_duplicate" and end("tombstone", "evidence_key")["disposition"] == "noop"
    assert (end("claim", "claim_key")["disposition"], end("claim", "claim_key")["code"]) == ("review", "conflict")
    assert judge(spark, [{}], scorer=True)[0]["code"] == "scorer_uncertain" and judge(spark, []) == []
    moved = judge(spark, [{"room": "other"}, {"evidence": ["S1", "S2"]}])
    assert moved[0]["claim_key"] != r["claim_key"] and moved[0]["evidence_key"] == r["evidence_key"] and moved[1]["evidence_key"] != r["evidence_key"]


def test_protected_tokens(spark):
    texts = ["Deploy v2.1 at 10:30 on March 3. Bob saw max_conns hit 25 GB, not 40%, says Ann.", "", "The API and Redis, Redis", None, "with \x01a:odd\x02 marks"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ve.lexis("t").alias("l")).orderBy("i")
    rows = [r["l"] for r in df.collect()]
    assert rows[0]["protected"] == ["times:10:30", "dates:March 3", "versions:v2.1", "identifiers:max_conns", "units:25 GB", "units:40%", "names:Ann"]
    assert rows[1]["protected"] == [] and rows[2]["anchors"] == ["api", "redis", "redis"] and rows[3]["clauses"] == []
    assert rows[4]["anchors"] == ["odd", "marks"]


def test_prompt_signals(spark):
    df = spark.createDataFrame([("fix src/main.rs, then foo_bar() panics",), ("ok",), (None,), ("see notes. a/b. x/.y main.rs?",)], "p string")
    got = [r["q"].asDict() for r in df.select(sg.prompt_quality(F.col("p"), F.lit("acme"), F.lit("feat/login-ui")).alias("q")).collect()]
    assert got[0] == {"contentful": 2, "vague": False, "signals": ["file_path", "code_symbol", "error_string"]}
    assert got[1] == got[2] == {"contentful": 0, "vague": True, "signals": []} and got[3]["signals"] == ["file_path"]
    rows = df.select(sg.file_paths(F.col("p")).alias("f"), sg.code_symbols(F.col("p")).alias("c")).collect()
    assert rows[0]["f"] == ["src/main.rs"] and rows[0]["c"] == ["foo_bar"] and rows[3]["f"] == ["x/.y", "main.rs"]
    assert spark.range(1).select(sg.prompt_quality(F.lit("the login page"), F.lit(None).cast("string"), F.lit("feat/login-ui")).signals.alias("s")).first()["s"] == ["repo_term"]


def test_graph_channel(spark):
    asked = ch.query_entities(spark.createDataFrame([(1, "About Redis cache"), (2, None), (3, "zzz")], "query_id int, q string"), spark.createDataFrame([(7, "redis"), (8, "Kafka"), (9, None)], "entity_id int, name string"),
                              spark.createDataFrame([(3, "KAFKA")], "query_id int, name string"))
    assert sorted(map(tuple, asked.collect())) == [(1, 7), (3, 8)]
    mentions = spark.createDataFrame([(7, 10), (7, 10), (7, 11), (7, 99), (8, 12)], "entity_id int, id int")
    links = spark.createDataFrame([(10, 11, .9), (10, 20, .8), (10, 21, .5), (10, 99, .9), *[(11, 30 + i, .6) for i in range(7)]], "src int, dst int, similarity double")
    live = spark.createDataFrame([(i,) for i in [10, 11, 12, 20, 21, *range(30, 37)]], "id int")
    got = [(r["query_id"], r["id"], r["hop"]) for r in ch.graph_channel(asked, mentions, links, live, 6).orderBy("query_id", "rank").collect()]
    assert got == [(1, 10, 1), (1, 11, 1), (1, 20, 2), (1, 30, 2), (1, 31, 2), (1, 32, 2), (3, 12, 1)]


def test_hits_and_access(spark):
    scored = spark.createDataFrame([(1, 5, .9, .77, False), (1, 6, .9, None, True), (1, 7, .1, None, False)], "query_id int, id int, score double, ce_prob double, via_spread boolean")
    channels = spark.createDataFrame([(1, 5, "semantic", 2, .5), (1, 5, "keyword", 1, None)], "query_id int, id int, channel string, rank int, sim double")
    notes = spark.createDataFrame([(5, .9, "a.md", "", 1), (6, .8, None, "bob", None)], "id int, confidence double, filename string, agent_id string, access_count long")
    hits = ch.assemble_hits(scored, channels, notes, 2)
    assert [(r["id"], r["source"], r["agent_id"], r["why"]) for r in hits.orderBy("place").collect()] == [
        (5, "a.md", None, "semantic match 0.50 (rank 2) + keyword match (rank 1); reranked 0.77"), (6, "", "bob", "linked neighbour (spreading activation)")]
    assert {r["id"]: r["access_count"] for r in ch.bump_access(notes, hits).collect()} == {5: 2, 6: 1}


def test_transcript(spark):
    lines = ['{"type":"user","message":{"content":"[1] hi"}}', '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool_use"},{"type":"text","text":"b"}]}}',
             '{"type":"user","message":{"role":"assistant","content":"x"}}', '{"type":"user","isMeta":true,"message":{"content":"x"}}', '{"type":"user","message":{"content":[{"type":"tool_result"}]}}',
             '{"type":"user","toolUseResult":{"a":1},"message":{"content":" "}}', '{"type":"user","message":{"content":7}}', '{broken', " ", None, '{"type":"user","message":{"content":[]}}', '{"type":"system"}']
    got = parse_transcript(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")).orderBy("i").collect()
    assert [r["status"] for r in got] == ["text", "text", "skipped", "skipped", "tool", "tool", "skipped", "skipped", "blank", "blank", "skipped", "skipped"]
    assert (got[0]["role"], got[0]["text"], got[1]["text"], got[2]["text"]) == ("user", "[1] hi", "a\n\nb", None)


def test_listings(spark, tmp_path):
    for name, data in [("a.PNG", b"1"), ("b.md", b"caf\xc3\xa9"), (".hidden.png", b"1"), ("readme.MD", b"x"), ("c.bin", b"\xff\xfe"), ("big.txt", b"x" * (listing.INLINE_BYTES + 1)), ("sub/d.jpg", b"1"), ("trash/e.jpg", b"1")]:
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    root = f"file://{tmp_path}"
    assert sorted(r["name"] for r in listing.list_images(spark, root).collect()) == ["a.PNG", "d.jpg"]
    assert [r["name"] for r in listing.list_images(spark, root, recursive=False, limit=1).collect()] == ["a.PNG"]
    assert [r["name"] for r in listing.list_inbox(spark, root).collect()] == ["a.PNG", "b.md", "big.txt", "c.bin"]
    read = {r["name"]: (r["text"], r["is_binary"], r["truncated"]) for r in listing.read_inbox(spark, root).collect()}
    assert read["b.md"] == ("café", False, False) and read["c.bin"] == (None, True, False) and read["big.txt"] == (None, False, True)


def test_decisions(spark):
    p = spark.createDataFrame([("a", "unreviewed", ["body"]), ("b", "rejected", ["body"])], "proposal_id string, review_status string, fields array<string>")
    rows = [(1, "a", True, {"nope": "x"}), (2, "a", True, {"body": "x"}), (3, "a", True, {"body": "y"}), (4, "a", False, None), (5, "b", None, None), (6, "b", True, None), (7, "zz", True, None)]
    got = rv.decide(p, spark.createDataFrame(rows, "decision_id int, proposal_id string, approve boolean, edits map<string,string>")).orderBy("decision_id").collect()
    assert [r["outcome"] for r in got] == ["refused", "applied", "repeated", "refused", "repeated", "refused", "unknown"]
    assert [r["review_status"] for r in got] == ["unreviewed", "edited", "edited", "edited", "rejected", "rejected", None] and got[1]["idempotency_key"] == "decide-a-approve"


def test_writes(spark):
    notes = spark.createDataFrame([(1, "note", "fresh"), (2, None, None), (3, "clip", "dormant")], "id int, kind string, state string")
    ids = spark.createDataFrame([(1,), (2,), (2,), (9,)], "id int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(wr.set_kind(notes, ids, "note")) == [(1, "unchanged"), (2, "updated"), (9, "not_found")]
    assert {r["id"]: r["kind"] for r in wr.with_kind(notes, ids, "x").collect()} == {1: "x", 2: "x", 3: "clip"}
    assert {r["id"]: r["state"] for r in wr.soft_delete(notes, ids).collect()} == {1: "dormant", 2: "dormant", 3: "dormant"} and {r["id"] for r in wr.purge(notes).collect()} == {1, 2}
    links = spark.createDataFrame([(1, 2, "manual", .1), (2, 3, None, .5)], "src int, dst int, link_type string, similarity double")
    new = spark.createDataFrame([(1, 2, "manual", 7.0), (1, 1, "manual", .5), (1, 77, "manual", .5)], "src int, dst int, link_type string, similarity double")
    assert rows(wr.add_links(links, new, notes)) == [(1, 2, "manual", 1.0), (2, 1, "manual", 1.0), (2, 3, None, .5)]
    assert rows(wr.remove_links(links, spark.createDataFrame([(3, 2, None)], "src int, dst int, link_type string"))) == [(1, 2, "manual", .1)]
    assert rows(wr.strip(links, spark.createDataFrame([(3,)], "id int"), "src", "dst")) == [(1, 2, "manual", .1)]
    tags = spark.createDataFrame([('["a"]',), (None,), ("oops",), ('["b","a"]',)], "t string").select(wr.append_tag(F.col("t"), "a").alias("t"))
    assert [r["t"] for r in tags.collect()] == ['["a"]', '["a"]', '["a"]', '["b","a"]']
    got = wr.override(spark.createDataFrame([(.6, 3)], "floor double, most int"), spark.createDataFrame([("x", None, 5), ("y", .4, None)], "brain string, floor double, most int"), "brain", ["floor", "most"])
    assert rows(got) == [("x", .6, 5), ("y", .4, 3)]


@pytest.mark.parametrize("name", sorted(qv.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "events", "lineitem", "nation", "orders", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = qv.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(qv.ORACLES[name]).df()
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    text = lambda v: "null" if pd.isna(v) else str(v) if isinstance(v, (bool, str)) else f"{float(v):.6g}"
    flat = lambda df: sorted(tuple(map(text, r)) for r in df[key].astype(object).itertuples(index=False))
    assert flat(got) == flat(want)
