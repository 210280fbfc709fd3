import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlake import queries_reports as qr
from memlake.operators import graph as gr
from memlake.operators import reports as rp
from memlake.sources import vault


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_md", ".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def test_read_notes_and_stats(spark, tmp_path):
    put(tmp_path, **{"Sub dir__draft-my-plan_md": "no heading", "a+b%_md": "# Élan\n\ntext", "x.txt": "no", "empty_md": ""})
    root = f"file://{tmp_path}"
    got = {r["filename"]: (r["title"], r["kind"], r["content"]) for r in vault.read_notes(spark, root).collect()}
    assert got == {"Sub dir/draft-my-plan.md": ("draft my plan", "draft", "no heading"), "a+b%.md": ("Élan", "note", "# Élan\n\ntext")}
    stats = vault.vault_stats(spark, root).first()
    assert (stats["notes"], stats["bytes"]) == (2, len("no heading") + len("# Élan\n\ntext".encode())) and stats["newest"] is not None
    current = vault.read_notes(spark, root).where("filename = 'a+b%.md'").select("filename", "content_hash", F.lit("fresh").alias("state"))
    assert {r["action"]: r["files"] for r in vault.import_counts(current, vault.read_notes(spark, root)).collect()} == {"skip": 1, "insert": 1}


def test_watch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    put(src, one_md="# One")
    run = lambda: vault.watch_notes(spark, f"file://{src}", lambda df, i: df.write.mode("append").parquet(f"file://{out}"), f"file://{tmp_path}/cp").awaitTermination()
    run()
    put(src, two_md="# Two")
    run()
    assert sorted(r["title"] for r in spark.read.parquet(f"file://{out}").collect()) == ["One", "Two"]


def test_journal(spark, tmp_path):
    names = [f.name for f in vault.T._parse_datatype_string(vault.EVENT).fields]
    row = lambda **kw: tuple({"event_id": "e", "seq": 1, "ts": "2024-01-31T23:59:59Z", "object_type": "engram", "object_id": "r/a.md", **kw}.get(n) for n in names)
    rows = [row(event_id="a"), row(event_id="b", ts="2024-02-01T00:00:00Z", room="r", before="x" * 3000), row(event_id="c", ts="2024-03-01T00:00:00Z"), row(event_id="d", ts="2024-02-02T00:00:00Z", room="q", object_id="q/z.md"),
            row(event_id="p1", privacy_label="Sensitive"), row(event_id="p2", object_id="r/_private/x.md"), row(event_id="p3", room=".hidden"), row(event_id="bad", ts="2024-02-oops")]
    folder = f"file://{tmp_path}/j"
    vault.write_journal(spark.createDataFrame(rows, vault.EVENT), folder)
    (tmp_path / "j" / "month=2024-02" / "torn.json").write_text("{broken\n")
    read = lambda **kw: vault.read_journal(spark, folder, dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 28), **kw)
    assert sorted(r["event_id"] for r in read().collect()) == ["a", "b", "d"] and sorted(r["event_id"] for r in read(room="r").collect()) == ["a", "b"]
    assert read().where("event_id = 'b'").first()["before"] == "x" * 2000
    assert "PartitionFilters: [month#" in read()._jdf.queryExecution().toString()


def test_contradictions(spark):
    pairs = spark.createDataFrame([(1, 10, 11, " ", "says x", False, 5), (2, 10, 12, "f", "g", None, 6), (3, 10, 11, "f", "g", True, 7)], "id int, a int, b int, fact_a string, fact_b string, resolved boolean, detected_at int")
    notes = spark.createDataFrame([(10, "Ten", None, None), (11, "El", "fresh", None), (12, "Tw", "dormant", None)], "id int, title string, state string, superseded_by int")
    got = {r["id"]: (r["claim_a"], r["claim_b"], r["title_b"]) for r in rp.contradictions(pairs, notes).collect()}
    assert got == {1: ("Ten", "says x", "El"), 2: ("f", "g", "Tw")}
    assert [r["id"] for r in rp.contradictions(pairs, notes, live_only=True, resolved=None).orderBy("id").collect()] == [1, 3]


def test_inbox_patterns(spark):
    log = spark.createDataFrame([(1, 1, "open", "h", "("), (2, 2, "open", None, " "), (3, 3, "open", None, None), (4, 4, "open", "h", "^bo"), (5, 5, "open", "h", "bob"), (5, 6, "done", "h", "bob")], "id int, position int, status string, kind string, agent_match string")
    assert sorted(r["id"] for r in rp.agent_inbox(log, "bob").collect()) == [2, 3, 4] and [r["id"] for r in rp.agent_inbox(log, "bob", handoffs_only=True).collect()] == [4]


def test_log_tail_and_harness(spark):
    log = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 9, "b"), (4, None, "a")], "id int, ts int, tool string")
    assert [r["id"] for r in rp.log_tail(log, 2, tool="a").collect()] == [2, 1] and [r["id"] for r in rp.log_tail(log, 1).collect()] == [3]
    got = rp.harness_metrics(spark.createDataFrame([(1, 10.0), (None, 30.0), (4, 20.0)], "first_hit_rank int, latency_ms double")).first()
    assert (got["n"], round(got["hit_1"], 4), round(got["hit_5"], 4), round(got["mrr"], 6), got["median_ms"], got["p95_ms"]) == (3, .3333, .6667, .416667, 20.0, 30.0)
    empty = rp.harness_metrics(spark.createDataFrame([], "first_hit_rank int, latency_ms double")).first()
    assert (empty["n"], empty["hit_1"], empty["mrr"], empty["median_ms"]) == (0, 0.0, 0.0, None)


def test_observe(spark):
    rows = [("PostToolUse", '{"tool":"Edit","sessionId":"abcdefghij","tool_input":{"a":1},"output":"x <private>s</private>"}'), ("PostToolUse", '{"tool_name":"Read"}'), ("SessionEnd", '{"summary":"done"}'), ("SessionStart", "{oops"), (None, None)]
    df = spark.createDataFrame(rows, "event string, payload string")
    got = rp.observe(df).collect()
    assert [r["status"] for r in got] == ["observed", "skipped_non_mutation", "observed", "observed", "skipped_unknown_event"]
    assert got[0]["title"] == "Edit · abcdefgh" and '{"a":1}' in got[0]["markdown"] and "x [private content removed]" in got[0]["markdown"] and got[1]["markdown"] is None
    assert got[2]["markdown"].endswith("## Summary\n\ndone\n") and got[3]["title"] == "Session start · unknown"
    assert [r["status"] for r in rp.observe(df, "off").collect()][:2] == ["skipped_posttooluse_off"] * 2 and rp.observe(df, "all").collect()[1]["status"] == "observed"


def test_remember(spark):
    rows = [(1, " T ", "x", .9, None), (2, None, "## Head\nbody", None, None), (3, "", "", None, [70]), (4, "t", "é" * 17000, None, None), (5, "t", "x", .95, None), (6, "t", "x", None, None)]
    asked = spark.createDataFrame(rows, "request_id int, title string, content string, deduplicate double, supersedes array<int>")
    nearest = spark.createDataFrame([(1, 70, .9), (2, 70, .8234), (3, 70, .85), (5, 70, .92), (6, 71, .85)], "request_id int, id int, similarity double")
    notes = spark.createDataFrame([(70, None), (71, 70)], "id int, superseded_by int")
    got = [tuple(r) for r in rp.remember_plan(asked, nearest, notes).orderBy("request_id").collect()]
    assert got == [(1, "merged", "T", 70, None, .9), (2, "created", "Head", None, 70, .823), (3, "created", "Untitled", None, None, None), (4, "too_large", "t", None, None, None), (5, "created", "t", None, None, None), (6, "created", "t", None, None, None)]


def test_wikilink_graph(spark):
    rows = [("a.md", "Alpha", "[[Beta]] [[beta|uses]] [[Plan]] [[alpha]] [[nowhere]]"), ("b.md", "Beta", "[[ALPHA]] [[Twin]]"), ("p.md", "Plan (v2)", None), ("t1.md", "Twin (x)", "[[Gamma]]"), ("t2.md", "Twin (y)", ""), ("g1.md", "Gamma", ""), ("g2.md", "gamma", "")]
    got = gr.wikilink_graph(spark.createDataFrame(rows, "filename string, title string, content string"))
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == [("a.md", "b.md"), ("a.md", "p.md"), ("t1.md", "g2.md")]
    assert gr.wikilink_graph(spark.createDataFrame([], "filename string, title string, content string")).count() == 0


@pytest.mark.parametrize("name", sorted(qr.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "events", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = qr.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(qr.ORACLES[name]).df()
    key = sorted(got.columns)
    assert key == sorted(want.columns)
    text = lambda v: "null" if pd.isna(v) else str(v) if isinstance(v, (bool, str)) else f"{float(v):.6g}"
    flat = lambda df: sorted(tuple(map(text, r)) for r in df[key].astype(object).itertuples(index=False))
    assert flat(got) == flat(want)
