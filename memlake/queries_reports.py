"""Report, queue and memory-write queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import reports as rp
from memlake.registry import register, table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


@query("""WITH r AS (SELECT CASE WHEN event_id % 4 > 0 THEN event_id % 15 + 1 END AS k, value AS ms FROM events)
SELECT count(*) AS n, avg((coalesce(k <= 1, false))::INT) AS hit_1, avg((coalesce(k <= 3, false))::INT) AS hit_3, avg((coalesce(k <= 5, false))::INT) AS hit_5, avg((coalesce(k <= 10, false))::INT) AS hit_10,
avg(coalesce(1.0 / k, 0)) AS mrr, quantile_cont(ms, 0.5) AS median_ms, quantile_cont(ms, 0.95) AS p95_ms FROM r""")
def harness_metrics(spark, sf_dir):
    """Events as questions with made ranks, their values as latencies."""
    i = F.col("event_id")
    return rp.harness_metrics(table(spark, sf_dir, "events").select(F.when(i % 4 > 0, i % 15 + 1).alias("first_hit_rank"), F.col("value").alias("latency_ms")))


PATTERNS = ["", "user-(7|9)", "^user-7$", "bot", "user-.", None]


@query("""WITH l AS (SELECT event_id % 900 AS id, event_id AS p, ['open', 'done'][event_id % 2 + 1] AS status, CASE WHEN event_id % 3 = 0 THEN 'handoff' END AS kind, ['', 'user-(7|9)', '^user-7$', 'bot', 'user-.', NULL][event_id % 6 + 1] AS m FROM events),
t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC) = 1) SELECT id, p AS position FROM t WHERE status = 'open' AND kind IS NOT NULL AND (coalesce(m, '') = '' OR regexp_matches('user-7', m))""")
def agent_inbox(spark, sf_dir):
    """Hand-offs open to one agent, from events as a log of todos."""
    i = F.col("event_id")
    log = table(spark, sf_dir, "events").select(
        (i % 900).alias("id"), i.alias("position"), F.when(i % 2 == 0, "open").otherwise("done").alias("status"), F.when(i % 3 == 0, "handoff").alias("kind"),
        F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (i % 6 + 1).cast("int")).alias("agent_match"))
    return rp.agent_inbox(log, "user-7", handoffs_only=True).select("id", "position")


@query("""WITH d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY 1 LIMIT 20), c AS (SELECT event_id AS id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 20),
o AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_returnflag = 'R' ORDER BY 1, 2 LIMIT 20),
q AS (SELECT 'duplicate' AS kind, 'dup:' || id AS key FROM d UNION ALL SELECT 'contradiction', 'contra:' || id FROM c UNION ALL SELECT 'orphan', 'orphan:' || s || ':' || t FROM o)
SELECT * FROM q WHERE key NOT IN (SELECT 'dup:' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0)""")
def work_queue(spark, sf_dir):
    """New work, orders as duplicates, events as conflicts, returned lines as orphans."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    orphans = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("target")).distinct()
    known = orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("dup:"), F.col("o_orderkey").cast("string")).alias("key"))
    return rp.work_queue(orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("ts").alias("detected_at")), orphans, known)


@query("""WITH j AS (SELECT 'note' AS ot, user_id AS oid, event_type AS ct, (event_id % 10) / 10.0::DOUBLE AS w, event_id AS t FROM events), s AS (SELECT 'note' AS ot, o_custkey AS oid, o_orderstatus AS ct, .35::DOUBLE AS w, o_orderkey AS t FROM orders),
u AS (SELECT *, false AS backfill FROM j UNION ALL SELECT *, true FROM s WHERE oid NOT IN (SELECT oid FROM j))
SELECT ot AS object_type, oid AS object_id, ct AS change_type, w AS weight, t AS ts, backfill FROM u QUALIFY row_number() OVER (PARTITION BY ot, oid ORDER BY w DESC, t, ct) = 1""")
def change_backfill(spark, sf_dir):
    """Events as the journal, orders as the state that fills in."""
    made = lambda df, oid, ct, w, t: df.select(F.lit("note").alias("object_type"), F.col(oid).alias("object_id"), F.col(ct).alias("change_type"), w.alias("weight"), F.col(t).alias("ts"))
    journal = made(table(spark, sf_dir, "events"), "user_id", "event_type", (F.col("event_id") % 10) / 10.0, "event_id")
    return rp.merge_changes(journal, made(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", F.lit(0.35), "o_orderkey"))


@query("""SELECT event_id, CASE WHEN nullif(x, '') IS NOT NULL THEN 'superseded' WHEN s IN ('archived', 'rejected') THEN s WHEN s = 'dormant' THEN 'deleted' END AS verdict
FROM (SELECT event_id, ['fresh', 'archived', 'rejected', 'dormant'][event_id % 4 + 1] AS s, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'n2' END AS x FROM events)""")
def lifecycle_verdicts(spark, sf_dir):
    """P7."""
    i = F.col("event_id")
    state = F.element_at(F.array(*[F.lit(s) for s in ("fresh", "archived", "rejected", "dormant")]), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", rp.lifecycle_verdict(state, F.when(i % 7 == 0, "").when(i % 7 == 1, "n2")).alias("verdict"))


@query(r"""WITH x AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '<private>.*?</private>', '[private content removed]', 'gis') AS p FROM conversations),
y AS (SELECT *, trim(regexp_replace(p, '\s+', ' ', 'g')) AS l FROM x)
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'observed' ELSE 'skipped_unknown_event' END AS status, CASE role WHEN 'user' THEN 'User prompt · ' || left(l, 60) || CASE WHEN length(l) > 60 THEN '…' ELSE '' END END AS title,
CASE role WHEN 'user' THEN md5('**Event:** UserPromptSubmit' || chr(10) || '**Session:** `' || conv_id || '`' || chr(10) || '**Time:** unknown' || chr(10) || chr(10) || '## Prompt' || chr(10) || chr(10) || p || chr(10)) END AS markdown_md5 FROM y""")
def observation_notes(spark, sf_dir):
    """Turns as hook calls; only the user's are observed."""
    payload = F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("prompt")))
    hooks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "UserPromptSubmit").otherwise("Other").alias("event"), payload.alias("payload"))
    return rp.observe(hooks).select("conv_id", "turn", "status", "title", F.md5("markdown").alias("markdown_md5"))
