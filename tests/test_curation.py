"""Curation, orchestration, summaries and code scan on hand-made rows."""

import datetime as dt
import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlake import queries_curation as qc
from memlake.functions import text as tx
from memlake.operators import code_scan as cs
from memlake.operators import curation as cu
from memlake.operators import notes as no
from memlake.operators import orchestrate as oc


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("x")).first()["x"]


def test_envelopes(spark):
    good = {"type": "fact", "statement": "s", "subject": "x", "evidence": ["S1"]}
    cases = [
        ({"proposals": [good], "nothing_durable": False}, None), ({"proposals": [], "nothing_durable": True}, None),
        ({"proposals": [], "nothing_durable": False}, "incoherent_abstention"), ({"proposals": [good] * 6, "nothing_durable": False}, "too_many_candidates"),
        ({"proposals": [{**good, "statement": "é" * 151}], "nothing_durable": False}, "statement_length"),
        ({"proposals": [{**good, "subject": "y" * 41}], "nothing_durable": False}, "subject_length"),
        ({"proposals": [{**good, "evidence": []}], "nothing_durable": False}, "evidence_count"), ({"proposals": None}, "malformed")]
    for body, want in cases:
        assert one(spark, cu.envelope_verdict(F.col("t")), t=json.dumps(body)) == want
    assert one(spark, cu.envelope_verdict(F.col("t")), t="{") == "malformed" and one(spark, cu.envelope_verdict(F.col("t")), t=None) == "missing"


def test_policy_denies_what_it_does_not_name(spark):
    got = lambda c, a, w: one(spark, cu.class_permission(F.col("c"), F.col("a"), F.col("w")), c=c, a=a, w=w)
    assert got("fact", "assistant", "pasted") == "weak" and got("decision", "assistant", "direct") == "deny" and got(None, "assistant", "direct") == "deny"


def test_dispositions_stop_at_the_first_terminal_gate(spark):
    rows = [(1, 0, "pass"), (1, 1, "review"), (1, 2, "defer"), (1, 3, "reject"), (2, 0, "review"), (2, 1, "pass"), (3, 0, "pass")]
    got = {r["c"]: (r["disposition"], r["stopped_at"], r["reviews"]) for r in cu.dispositions(spark.createDataFrame(rows, "c int, gate int, effect string"), "c").collect()}
    assert got == {1: ("defer", 2, 1), 2: ("review", None, 1), 3: ("ready", None, 0)}


def test_ledger_counts_attempts_and_expires_visibly(spark):
    now, day = dt.datetime(2024, 1, 20), dt.timedelta(days=1)
    rows = [(1, "pending", 0, None, now + day, "deferred"), (2, "deferred", 2, now, now + day, "deferred"), (3, "deferred", 1, now + day, now + day, "completed"),
            (4, "pending", 0, None, now, "completed"), (5, "pending", 0, None, now + day, None), (6, "completed", 0, None, now - day, "deferred")]
    df = spark.createDataFrame(rows, "id int, status string, attempts int, retry_after timestamp, expires_at timestamp, outcome string")
    got = {r["id"]: (r["due"], r["next_status"], r["next_attempts"]) for r in cu.ledger_step(df, F.lit("2024-01-20").cast("timestamp")).collect()}
    assert got == {1: (True, "deferred", 1), 2: (True, "expired_visible", 3), 3: (False, "deferred", 1), 4: (False, "expired_visible", 0), 5: (True, "pending", 0), 6: (False, "completed", 0)}


EVENTS = "event_id string, event_type string, ts int, session_id string, room string, object_id string, title string, capture_method string, source_refs array<string>"


def test_rules_and_store(spark):
    rows = [("e1", "task_completed", 1, "s", "r", "o1", "T", "hook", ["reason:x", "n1"]), ("e2", "note_created", 2, "s", "r", "o2", "Quarterly plan A", "hook", []),
            ("e3", "note_created", 3, "s", "r", "o3", "quarterly-plan b", "hook", []), ("e4", "context_decision", 4, "s", None, "o4", None, "hook", None),
            ("e5", "session_ended", 5, "s", None, "o5", None, "hook", None), ("e6", "task_completed", 6, "s", "r", "o6", "T", "review", ["n2"])]
    evidence = cu.rule_evidence(spark.createDataFrame(rows, EVENTS))
    made = cu.propose(evidence)
    got = {(r["action"], r["object_id"]): r["n_evidence"] for r in made.collect()}
    assert got == {("memory_strengthened", "n1"): 1, ("supersession_suggestion", "o2"): 2, ("working_state_refresh", "s"): 2, ("room_summary_refresh", "r"): 3}
    assert {r["proposal_id"] for r in cu.propose(evidence.unionByName(evidence)).collect()} == {r["proposal_id"] for r in made.collect()}
    store = made.where("action = 'memory_strengthened'").select("proposal_id", "action", "object_id", F.lit("accepted").alias("review_status")).unionByName(
        spark.createDataFrame([("old", "room_summary_refresh", "r", "rejected")], "proposal_id string, action string, object_id string, review_status string"))
    fresh = {r["action"]: r["predecessor"] for r in cu.new_proposals(made, store).collect()}
    assert fresh == {"supersession_suggestion": None, "working_state_refresh": None, "room_summary_refresh": "old"}
    touched = spark.createDataFrame([*rows, ("e7", "working_state_updated", 7, "s", None, "o", None, "hook", None)], EVENTS)
    assert cu.rule_evidence(touched).where("action = 'working_state_refresh'").count() == 0
    assert cu.propose(cu.rule_evidence(spark.createDataFrame([], EVENTS))).count() == 0


def test_recipe_dedups_floors_and_fills_by_salience(spark):
    shape = "query_id int, intent string, section int, id int, rank int, ce double, salience double, live boolean"
    rows = [(1, "explain_decision", 1, 10, 1, 0.1, 0.9, True), (1, "explain_decision", 1, 11, 2, 0.9, 0.2, True), (1, "explain_decision", 1, 12, 3, 0.9, 1.0, False),
            (1, "explain_decision", 2, 10, 1, 0.9, 0.9, True), (1, "explain_decision", 2, 13, 2, 0.5, 0.1, True), (1, "explain_decision", 2, 14, 3, 0.44, 0.9, True)]
    got = [(r["section"], r["place"], r["id"]) for r in oc.run_recipe(spark.createDataFrame(rows, shape), oc.recipes(spark)).orderBy("section", "place").collect()]
    assert got[-1] == (2, 1, 13) and (2, 1, 10) not in got and 12 not in [g[2] for g in got] and 14 not in [g[2] for g in got]
    assert oc.recipes(spark).where("title = 'Relevant decisions' and quota").count() == 3


def test_facts_move_their_notes(spark):
    queries = spark.createDataFrame([(1, "what is our grocery budget now"), (2, "grocery budget for june")], "query_id int, q string")
    facts = spark.createDataFrame([("grocery budget", None, "£550", 7, True), ("grocery budget", "", "£400", 8, False), ("api host", "", "x", 9, True), (None, None, None, 5, True)],
                                  "subject string, attribute string, value string, id int, current boolean")
    adjusted = oc.fact_adjustment(queries, facts)
    got = {(r["query_id"], r["id"]): (r["boost"], r["demote"]) for r in adjusted.collect()}
    assert got == {(1, 7): (0.25, 0.0), (1, 8): (0.0, 0.15), (2, 7): (0.25, 0.0)}
    scores = spark.createDataFrame([(1, 3, 0.5)], "query_id int, id int, score double")
    assert {(r["query_id"], r["id"], r["score"]) for r in oc.apply_facts(scores, adjusted).collect()} == {(1, 3, 0.5), (1, 7, 0.25), (2, 7, 0.25)}
    ranked = oc.apply_rank(scores, spark.createDataFrame([(4, 1.0)], "id int, pagerank double")).collect()
    assert [r["score"] for r in ranked] == [0.5]


def test_summaries(spark):
    note = "---\na: b\n---\n# Deploy\n#ops #prod\n\nWe ship e.g. on **Fridays** via [[ci|the CI]]. Then rest.\n\nMore `code` here."
    plain = tx.plain_text(F.col("t"))
    assert one(spark, plain, t=note) == "Deploy\n\nWe ship e.g. on Fridays via the CI. Then rest.\n\nMore here." or "the CI" in one(spark, plain, t=note)
    assert one(spark, tx.summary_sentence(plain, F.lit("Plan.")), t="We ship e.g. Monday. Then rest.") == "Plan — We ship e.g. Monday."
    assert one(spark, tx.summary_sentence(plain, F.lit("We")), t="We ship. Then rest.") == "We ship."
    assert one(spark, tx.summary_paragraph(plain), t="Title\n\nA short one.\n\nother") == "A short one."
    assert len(one(spark, tx.summary_paragraph(plain), t="word " * 300)) <= 481
    assert one(spark, tx.summary_sentence(plain, F.lit(None).cast("string")), t=None) == ""


def test_anchors(spark):
    now, seen = F.lit("2024-01-18 15:00:00").cast("timestamp"), F.lit("2024-01-10 09:00:00").cast("timestamp")
    cases = [("what changed since 2024-01-03?", "explicit_date", "2024-01-03 00:00:00"), ("since 2024-99-03", "fallback", "2024-01-17 15:00:00"), ("new this week", "this_week", "2024-01-15 00:00:00"),
             ("did i miss anything", "since_last_session", "2024-01-10 09:00:00"), ("yesterday", "yesterday", "2024-01-17 00:00:00"), (None, "fallback", "2024-01-17 15:00:00")]
    for prompt, anchor, start in cases:
        got = one(spark, tx.resolve_anchor(F.col("t"), now, seen), t=prompt)
        assert (got["anchor"], str(got["start"])) == (anchor, start)


def test_paths(spark):
    assert one(spark, tx.normalize_room(F.col("t")), t=" /a/b/ ") == "a/b"
    assert [one(spark, tx.folder_of(F.col("t")), t=t) for t in ("a/b.md", "/a.md", "b.md")] == ["a", "", ""]


FILES = [
    ("src/a.py", "class Store:\n    def load_all(self):\n        return parse_row(1)\n\ndef main():\n    x = load_all()  # helper()\n    if (x):\n        main2(\"call(3)\")\n"),
    ("src/b.rs", "pub struct Row;\npub async fn parse_row(x: i32) -> Row {\n    other(x)\n}\n"),
    ("web/c.ts", "export const draw = (a: number) => paint(a)\nfunction paint(a) { return a }\n"),
    ("node_modules/d.py", "def hidden(): pass"), ("notes.md", "def nothing()"), ("big.py", "#" * (512 * 1024 + 1)), ("null.py", None), (None, "def f(): pass")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, source string")


def test_symbols(files):
    got = {(r["path"], r["line"], r["name"], r["kind"]) for r in cs.symbols(files).collect()}
    assert got == {("src/a.py", 1, "Store", "type"), ("src/a.py", 2, "load_all", "function"), ("src/a.py", 5, "main", "function"), ("src/b.rs", 1, "Row", "type"),
                   ("src/b.rs", 2, "parse_row", "function"), ("web/c.ts", 1, "draw", "function"), ("web/c.ts", 2, "paint", "function")}


def test_calls_and_notes(spark, files):
    defined, found = cs.symbols(files), cs.calls(files)
    kept = {(r["caller"], r["callee"]) for r in cs.resolved_calls(found, defined).collect()}
    assert kept == {("load_all", "parse_row"), ("main", "load_all"), ("draw", "paint")}
    assert {r["callee"] for r in found.collect()} == {"parse_row", "load_all", "main2", "other", "paint"}
    assert [r["path"] for r in cs.who_calls(found, "parse_row").collect()] == ["src/a.py"]
    assert [r["line"] for r in cs.in_file(defined, "b.rs").collect()] == [1, 2]
    notes = spark.createDataFrame([(1, "see `load_all` and `Row`, `load_all`"), (2, None)], "id int, content string")
    assert [(r["id"], r["path"]) for r in cs.notes_to_code(notes, defined).collect()] == [(1, "src/a.py")]


def test_query_operators():
    assert no.parse_query("kind:note after:2024-02-30 redis before:2024-03-01 state: a:b") == ("after:2024-02-30 redis state: a:b", {"kind": "note", "before": "2024-03-01"})


def test_filters_entity_and_default_kinds(spark):
    rows = [(1, "note", "A/x.md", "fresh", None, "bob"), (2, "observation", "A/y.md", "fresh", None, "bob"), (3, None, "B/z.md", None, None, None), (4, "note", "A/d.md", "dormant", None, "bob"), (5, "note", "A/s.md", "fresh", 1, "bob")]
    notes = spark.createDataFrame(rows, "id int, kind string, filename string, state string, superseded_by int, agent_id string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    live = no.visible(notes)
    assert ids(live) == [1, 2, 3] and ids(no.apply_filters(live, {})) == [1, 3] and ids(no.apply_filters(live, {"kind": "observation"})) == [2]
    mentions = spark.createDataFrame([(1, "Redis"), (1, "redis"), (3, "kafka")], "id int, name string")
    assert ids(no.apply_filters(live, {"entity": "REDIS"}, mentions)) == [1] and ids(no.apply_filters(live, {"folder": "a"})) == [1]


def test_supersede_guards(spark):
    notes = spark.createDataFrame([(1, None), (2, None), (3, 9)], "id int, superseded_by int")
    pairs = spark.createDataFrame([(1, 1), (2, 3), (2, 1), (3, 77)], "old_id int, new_id int")
    assert {r["id"]: r["superseded_by"] for r in no.supersede(notes, pairs).collect()} == {1: None, 2: 1, 3: 9}


def test_markers(spark):
    got = lambda t, k: one(spark, no.has_marker(F.col("t"), k), t=t)
    assert got("We didn't go", "negation") and got("Not yet", "negation") and not got("a notable event", "negation") and not got(None, "negation")
    assert got("tabs instead of spaces", "comparison") and got("it might, perhaps", "modality")


NEW = ["experience_rules", "home_activity", "gate_dispositions", "unit_ledger", "recipe_sections", "fact_adjustment", "temporal_brief", "operator_filters"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = qc.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(qc.ORACLES[name]).df()
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    text = lambda v: "null" if pd.isna(v) else str(v) if isinstance(v, (bool, str)) else f"{float(v):.6g}"
    flat = lambda df: sorted(tuple(map(text, r)) for r in df[key].astype(object).itertuples(index=False))
    assert flat(got) == flat(want)
