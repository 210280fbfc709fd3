"""Curation, multi-section recall and fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import curation as cu
from memlake.operators import notes as no
from memlake.operators import orchestrate as oc
from memlake.operators import vector as ve
from memlake.queries_retrieval import KNN_CTE, _tok
from memlake.registry import register, table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

NOW = "2024-01-20 12:00:00"
KINDS = ["task_completed", "note_created", "note_superseded", "session_ended", "context_decision", "playbook_rule_added", "note_updated", "turn"]


def _pick(value, names):
    """The name at place ``value`` (from 0)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (value + 1).cast("int"))


def _pick_sql(value: str, names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" if n is not None else "NULL" for n in names) + f"][({value}) + 1]"


def _journal(spark, sf_dir):
    """The events as a journal: kinds and titles come from their ids, users stand as sessions."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), _pick(i % 8, KINDS).alias("event_type"), F.col("user_id").alias("session_id"),
        F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("room"), F.concat(F.lit("o"), (i % 300).cast("string")).alias("object_id"),
        F.concat(F.lit("Release plan "), (F.floor(i / 8) % 40).cast("string")).alias("title"), F.lit("hook").alias("capture_method"),
        F.array(F.lit("caused_by:x"), F.concat(F.lit("n"), F.col("user_id").cast("string"))).alias("source_refs"),
        F.when(i % 16 == 4, F.concat(F.lit("inject 2; "), (i % 5).cast("string"), F.lit(" memories"))).otherwise("quiet").alias("after"))


JOURNAL = f"""e AS (SELECT event_id, ts, {_pick_sql('event_id % 8', KINDS)} AS k, user_id AS session, 'r' || (user_id % 50) AS room, 'o' || (event_id % 300) AS obj,
left('releaseplan' || ((event_id // 8) % 40), 12) AS tk, CASE WHEN event_id % 16 = 4 THEN event_id % 5 END AS shown FROM events)"""
ROOM_SQL = ", ".join(f"'{k}'" for k in cu.ROOM_EVENTS)


@query(f"""WITH {JOURNAL}, p AS (SELECT *, lead(event_id) OVER w AS b, lead(obj) OVER w AS o FROM e WHERE k = 'note_created' WINDOW w AS (PARTITION BY room, tk ORDER BY ts, event_id)),
x AS (SELECT session, arg_max(event_id, (ts, event_id)) AS fin FROM e WHERE k = 'session_ended' GROUP BY 1), u AS (SELECT session, fin, event_id FROM e JOIN x USING (session) WHERE k = 'context_decision'),
ev AS (SELECT 'memory_strengthened' AS action, 'n' || session AS object_id, event_id::VARCHAR AS unit, 'high' AS band, event_id FROM e WHERE k = 'task_completed'
UNION ALL SELECT 'supersession_suggestion', obj, o, 'medium', unnest([event_id, b]) FROM p WHERE b IS NOT NULL
UNION ALL SELECT 'working_state_refresh', session::VARCHAR, fin::VARCHAR, 'medium', event_id FROM u UNION ALL SELECT 'working_state_refresh', session::VARCHAR, fin::VARCHAR, 'medium', fin FROM u
UNION ALL SELECT 'room_summary_refresh', room, '', 'low', event_id FROM e WHERE k IN ({ROOM_SQL}))
SELECT action, object_id, unit, band, count(DISTINCT event_id) AS n_evidence FROM ev GROUP BY ALL HAVING action <> 'room_summary_refresh' OR count(DISTINCT event_id) >= 3""")
def experience_rules(spark, sf_dir):
    """Proposals of the four rules with their evidence counted."""
    return cu.propose(cu.rule_evidence(_journal(spark, sf_dir))).drop("proposal_id")


@query(f"""WITH {JOURNAL}, d AS (SELECT * FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '{NOW}')
SELECT count(DISTINCT session) AS sessions, count_if(k = 'context_decision' AND shown IS NOT NULL)::BIGINT AS context_added, count_if(k = 'context_decision' AND shown IS NULL)::BIGINT AS context_quiet,
coalesce(sum(CASE WHEN k = 'context_decision' THEN shown END), 0)::BIGINT AS memories, count_if(k IN ('note_created', 'note_updated'))::BIGINT AS notes_changed FROM d""")
def home_activity(spark, sf_dir):
    """The day's activity at a fixed now."""
    return cu.home_activity(_journal(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(f"""WITH {JOURNAL} SELECT k AS event_type, obj AS object_id FROM e WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND TIMESTAMP '{NOW}' AND k IN ({ROOM_SQL}, 'note_updated', 'working_state_updated')
GROUP BY 1, 2 ORDER BY max(ts) DESC, 1, 2 LIMIT 5""")
def home_changes(spark, sf_dir):
    """The five newest distinct changes of the last day."""
    return cu.home_changes(_journal(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("event_type", "object_id")


CLAIMS, WAYS = ["decision", "preference", "fact"], ["direct", "quoted", "forwarded", "pasted"]
_POLICY = " ".join(f"WHEN c = '{c}' AND a = '{a}' AND w = '{w}' THEN '{p}'" for c, a, w, p in cu.CLASS_POLICY)


@query(f"""WITH x AS (SELECT conv_id, turn, {_pick_sql('turn % 3', CLAIMS)} AS c, CASE role WHEN 'user' THEN 'first_party_user' ELSE role END AS a, {_pick_sql('conv_id % 4', WAYS)} AS w FROM conversations)
SELECT conv_id, turn, CASE {_POLICY} ELSE 'deny' END AS permission FROM x""")
def class_permission(spark, sf_dir):
    """V5: what each turn may support, with classes and authorship made from ids."""
    actor = F.when(F.col("role") == "user", "first_party_user").otherwise(F.col("role"))
    permission = cu.class_permission(_pick(F.col("turn") % 3, CLAIMS), actor, _pick(F.col("conv_id") % 4, WAYS))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", permission.alias("permission"))


EFFECTS = ["reject", "defer", "noop", "review", "review", *["pass"] * 15]


@query(f"""WITH g AS (SELECT event_id // 10 AS candidate, event_id % 10 AS gate, {_pick_sql('user_id % 20', EFFECTS)} AS effect FROM events),
s AS (SELECT *, min(CASE WHEN effect IN ('reject', 'defer', 'noop') THEN gate END) OVER (PARTITION BY candidate) AS stop FROM g),
d AS (SELECT candidate, max(stop) AS stopped_at, max(CASE WHEN gate = stop THEN effect END) AS fin, count_if(effect = 'review')::BIGINT AS reviews FROM s WHERE stop IS NULL OR gate <= stop GROUP BY candidate)
SELECT candidate, coalesce(fin, CASE WHEN reviews > 0 THEN 'review' ELSE 'ready' END) AS disposition, stopped_at, reviews FROM d""")
def gate_dispositions(spark, sf_dir):
    """V6: ten gates make a candidate."""
    i = F.col("event_id")
    gates = table(spark, sf_dir, "events").select(F.floor(i / 10).alias("candidate"), (i % 10).alias("gate"), _pick(F.col("user_id") % 20, EFFECTS).alias("effect"))
    return cu.dispositions(gates, "candidate")


STATES, OUTCOMES = ["pending", "deferred", "completed", "deferred"], ["deferred", "completed", None, "permanently_rejected"]


@query(f"""WITH u AS (SELECT event_id, {_pick_sql('event_id % 4', STATES)} AS status, event_id % 3 AS attempts, {_pick_sql('user_id % 4', OUTCOMES)} AS outcome, ts + to_hours((event_id % 30)::INT) AS retry, ts + INTERVAL 14 DAY AS ends FROM events),
o AS (SELECT *, status IN ('pending', 'deferred') AND ends <= TIMESTAMP '{NOW}' AS late FROM u), d AS (SELECT *, NOT late AND (status = 'pending' OR (status = 'deferred' AND retry <= TIMESTAMP '{NOW}')) AS due FROM o),
r AS (SELECT *, coalesce(due AND outcome = 'deferred', false) AS defers, coalesce(due AND outcome IN ('completed', 'permanently_rejected'), false) AS done FROM d)
SELECT event_id, due, CASE WHEN late OR (defers AND attempts >= 2) THEN 'expired_visible' WHEN done THEN outcome WHEN defers THEN 'deferred' ELSE status END AS next_status,
CASE WHEN defers THEN attempts + 1 ELSE attempts END AS next_attempts, CASE WHEN NOT late AND defers AND attempts < 2 THEN [1, 6][attempts + 1]::BIGINT END AS wait_hours FROM r""")
def unit_ledger(spark, sf_dir):
    """V9: one pass at a fixed now over events as units."""
    i, t = F.col("event_id"), F.unix_timestamp(F.col("ts").cast("timestamp"))
    now = F.lit(NOW).cast("timestamp")
    units = table(spark, sf_dir, "events").select(
        "event_id", _pick(i % 4, STATES).alias("status"), (i % 3).alias("attempts"), _pick(F.col("user_id") % 4, OUTCOMES).alias("outcome"),
        F.timestamp_seconds(t + (i % 30) * 3600).alias("retry_after"), F.timestamp_seconds(t + cu.TTL_DAYS * 86400).alias("expires_at"))
    out = cu.ledger_step(units, now)
    wait = F.when(F.col("next_attempts") > F.col("attempts"), F.floor((F.unix_timestamp("next_retry_after") - F.unix_timestamp(now)) / 3600))
    return out.select("event_id", "due", "next_status", "next_attempts", wait.alias("wait_hours"))


INTENTS = list(dict.fromkeys(r[0] for r in oc.RECIPES))
_num = lambda v: "NULL" if v is None else str(v)
_PLAN = "plan AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', {s}, '{t}', {n}, {str(src == 'playbook_rules' or own == 0.0).lower()}, {_num(own if own is not None else 0.0 if src == 'playbook_rules' else ce)})" for i, s, t, src, n, own, _, ce in oc.RECIPES
) + ") v(intent, section, title, max_items, quota, floor))"


@query(f"""WITH {KNN_CTE}, {_PLAN}, r AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM kq QUALIFY rank <= 40),
h AS (SELECT r.query_id, plan.*, r.id, r.rank, (1 + r.sim) / 2 AS ce, (r.id % 10) / 10.0 AS sal FROM r JOIN plan ON plan.intent = {_pick_sql('(query_id // 20) % 6', INTENTS)} WHERE (r.id + plan.section) % 3 <> 0 AND r.id % 7 <> 0),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY section, rank) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section, rank, id) AS pool FROM f), c AS (SELECT * REPLACE (CASE WHEN pool <= 24 THEN ce ELSE 0 END AS ce) FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY round(CASE WHEN quota THEN sal ELSE ce END, 9) DESC, round(CASE WHEN quota THEN ce ELSE sal END, 9) DESC, pool) AS place FROM c WHERE ce >= floor)
SELECT query_id, intent, section, title, id, round(ce, 6) AS ce, place::INT AS place FROM k WHERE place <= max_items""")
def recipe_sections(spark, sf_dir):
    """M2, M3: vector hits dealt over the sections of an intent that comes from the query's id."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    plan = oc.recipes(spark)
    hits = ve.knn(asked, vectors, 40, skip_self=True).withColumn("intent", _pick(F.floor(F.col("query_id") / 20) % 6, INTENTS))
    hits = hits.join(F.broadcast(plan.select("intent", "section")), "intent").where((F.col("id") + F.col("section")) % 3 != 0)
    hits = hits.select("query_id", "intent", "section", "id", "rank", ((1 + F.col("similarity")) / 2).alias("ce"), ((F.col("id") % 10) / 10.0).alias("salience"), (F.col("id") % 7 != 0).alias("live"))
    return oc.run_recipe(hits, plan).select("query_id", "intent", "section", "title", "id", F.round("ce", 6).alias("ce"), "place")


_STEM = "CASE " + " ".join(f"WHEN ends_with(t, '{s}') AND strlen(t) > {len(s) + 2} THEN left(t, length(t) - {len(s)})" for s in tx.SUFFIXES) + " ELSE t END"
_stems = lambda x: f"list_transform({x}, lambda t: {_STEM})"


@query(f"""WITH s AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), q AS (SELECT doc_id AS query_id, (CASE WHEN doc_id % 40 = 0 THEN 'currently ' ELSE '' END) || array_to_string(w, ' ') AS q FROM s WHERE doc_id % 20 = 0),
a AS (SELECT query_id, list_distinct({_tok('q')}) AS qt, regexp_matches(q, '{tx.CURRENCY}') AS asks FROM q), f AS (SELECT doc_id AS id, array_to_string(w[1:2], ' ') AS subject, doc_id % 2 = 0 AS cur, array_to_string(w[3:6], ' ') AS v FROM s),
g AS (SELECT id, subject, cur, list_distinct({_tok('subject')}) AS st, {_stems(_tok('v'))} AS av FROM f),
h AS (SELECT query_id, id, subject, cur, asks, len(list_filter(list_distinct({_stems('qt')}), lambda z: list_contains(av, z) AND NOT list_contains({_stems('st')}, z))) AS rel FROM a JOIN g ON len(st) > 0 AND list_has_all(qt, st)),
n AS (SELECT *, count_if(cur) OVER w AS n, max(CASE WHEN cur THEN rel END) OVER w AS most FROM h WINDOW w AS (PARTITION BY query_id, subject)),
o AS (SELECT query_id, id, sum(CASE WHEN cur AND (n = 1 OR (most > 0 AND rel = most)) THEN .25 ELSE 0 END)::DOUBLE AS boost, sum(CASE WHEN NOT cur AND asks AND n > 0 THEN .15 ELSE 0 END)::DOUBLE AS demote FROM n GROUP BY 1, 2)
SELECT query_id, id, round(boost, 6) AS boost, round(demote, 6) AS demote FROM o WHERE boost > 0 OR demote > 0""")
def fact_adjustment(spark, sf_dir):
    """Each document states a fact: two words are its subject, the next four its value; even ids are current."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    words = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.when(F.col("doc_id") % 40 == 0, "currently ").otherwise(""), F.array_join("w", " ")).alias("q"))
    facts = docs.select(F.col("doc_id").alias("id"), words(1, 2).alias("subject"), F.lit("").alias("attribute"), words(3, 4).alias("value"), (F.col("doc_id") % 2 == 0).alias("current"))
    return oc.fact_adjustment(asked, facts).select("query_id", "id", F.round("boost", 6).alias("boost"), F.round("demote", 6).alias("demote"))


@query(f"""WITH {KNN_CTE}, r AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM kq QUALIFY rank <= 20)
SELECT query_id, id, round(sim * (CASE WHEN id % 2 = 0 THEN 1 + .15 * ln(1 + (id % 11) / 3) ELSE 1 END), 6) AS score FROM r""")
def pagerank_multiplier(spark, sf_dir):
    """Made-up ranks of the even ids."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    scores = ve.knn(asked, vectors, 20, skip_self=True).select("query_id", "id", F.col("similarity").alias("score"))
    ranks = vectors.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), ((F.col("vec_id") % 11) / 3).alias("pagerank"))
    return oc.apply_rank(scores, ranks).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {KNN_CTE}, r AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM kq WHERE sim > .25 QUALIFY rank <= 10)
SELECT query_id, id, round(sim * .15, 6) AS boost FROM r""")
def title_semantic_boost(spark, sf_dir):
    """Vectors stand for titles, the floor lies where they are."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pool = ve.knn(asked, vectors, 60, skip_self=True)
    return oc.title_boost(pool, floor=0.25).select("query_id", "id", F.round("boost", 6).alias("boost"))


@query("""WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'since 2[0-9]{3}-[0-9]{2}-[0-9]{2}') THEN 'explicit_date' WHEN contains(q, 'yesterday') THEN 'yesterday' WHEN contains(q, 'today') THEN 'today' WHEN contains(q, 'this week') THEN 'this_week'
WHEN regexp_matches(q, 'did i miss|since last time|since i last|last worked on|since my last|since our last|while i was away') THEN 'fallback' WHEN regexp_matches(q, 'last 24|24 hours|24h') THEN 'last_24h' ELSE 'fallback' END AS anchor FROM t""")
def time_anchor(spark, sf_dir):
    """F34 with no session seen before."""
    anchor = tx.resolve_anchor(F.col("text"), F.lit(NOW).cast("timestamp"), F.lit(None).cast("timestamp"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", anchor["anchor"].alias("anchor"))


@query()
def summaries_of_documents(spark, sf_dir):
    """a sentence and a paragraph of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.plain_text(F.col("text")).alias("plain"))
    return docs.select("doc_id", tx.summary_sentence(F.col("plain"), F.lit("")).alias("l0"), tx.summary_paragraph(F.col("plain")).alias("l1"))


def _marker_sql(kind: str) -> str:
    return f"regexp_matches(lower(text), '{no.marker_pattern(kind).replace(chr(39), chr(39) * 2)}')"


@query("SELECT conv_id, turn, " + ", ".join(f"coalesce({_marker_sql(k)}, false) AS {k}" for k in no.MARKERS) + " FROM conversations")
def turn_markers(spark, sf_dir):
    """F29."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[no.has_marker(F.col("text"), k).alias(k) for k in no.MARKERS])


ASKED = "kind:note folder:web after:2024-01-10 before:2024-02-20 after:soon release plan"


@query("""WITH n AS (SELECT doc_id AS id, ['note', 'observation', 'task'][(doc_id % 3) + 1] AS kind, (CASE WHEN doc_id % 2 = 0 THEN 'web/' ELSE 'desk/' END) || doc_id AS filename, TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) AS made, doc_id % 7 = 0 AS dormant FROM documents)
SELECT id, filename FROM n WHERE NOT dormant AND kind = 'note' AND starts_with(filename, 'web/') AND made >= TIMESTAMP '2024-01-10' AND made < TIMESTAMP '2024-02-20'""")
def operator_filters(spark, sf_dir):
    """A query's operators over documents as notes."""
    i = F.col("doc_id")
    notes = table(spark, sf_dir, "documents").select(
        i.alias("id"), _pick(i % 3, ["note", "observation", "task"]).alias("kind"), F.concat(F.when(i % 2 == 0, "web/").otherwise("desk/"), i.cast("string")).alias("filename"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id % 60 as int))").alias("created_at"), F.when(i % 7 == 0, "dormant").otherwise("fresh").alias("state"), F.lit(None).cast("long").alias("superseded_by"))
    _, operators = no.parse_query(ASKED)
    return no.apply_filters(no.visible(notes), operators).select("id", "filename")


@query("""SELECT o_orderkey, o_orderstatus, coalesce(array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_partkey IS NOT NULL), ','), '') AS parts
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def note_detail(spark, sf_dir):
    """Orders as notes, their lines as links."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = no.note_detail(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], [], "links")
    return out.select("o_orderkey", "o_orderstatus", F.array_join(F.transform("links", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("""WITH r AS (SELECT p_size AS cluster, p_name, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
SELECT cluster, count(*) AS size, array_to_string(list(p_name ORDER BY r) FILTER (r <= 5), '|') AS titles FROM r GROUP BY cluster""")
def cluster_summaries(spark, sf_dir):
    """Part sizes as clusters, prices as ranks."""
    members = table(spark, sf_dir, "part").select(F.col("p_size").alias("cluster"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("rank"))
    return no.cluster_summaries(members).withColumn("titles", F.array_join("titles", "|"))


_KINDS_OF = ["decision_added", "updated", "task_created", "superseded", "archived", "created", "risk_changed", "source_added", "agent_run_completed"]
_SECTION_SQL = " ".join(f"WHEN k IN ({', '.join(repr(x) for x in kinds)}) THEN {i}" for i, (_, kinds) in enumerate(no.SECTIONS, 1))


@query(f"""WITH c AS (SELECT user_id, event_id, {_pick_sql('event_id % 9', _KINDS_OF)} AS k, (event_id % 97) / 96.0 AS w FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(w, 9) DESC, event_id) AS r FROM c WHERE w >= .30), s AS (SELECT *, CASE WHEN r <= 3 THEN 0 ELSE CASE {_SECTION_SQL} END END AS sec FROM r),
p AS (SELECT *, row_number() OVER w1 AS place, sum(length(k || ' ' || event_id) + 1) OVER (PARTITION BY user_id ORDER BY sec, r ROWS UNBOUNDED PRECEDING) // 4 AS tokens FROM s WINDOW w1 AS (PARTITION BY user_id ORDER BY sec, r))
SELECT user_id, place::INT AS place, {_pick_sql('sec', ['Most important changes', *[n for n, _ in no.SECTIONS]])} AS section, event_id AS change_id, tokens::BIGINT AS tokens FROM p WHERE tokens <= 40""")
def temporal_brief(spark, sf_dir):
    """T-6: users as scopes."""
    i = F.col("event_id")
    kind = _pick(i % 9, _KINDS_OF)
    c = table(spark, sf_dir, "events").select("user_id", i.alias("change_id"), kind.alias("change_type"), ((i % 97) / 96.0).alias("importance"), F.concat(kind, F.lit(" "), i.cast("string")).alias("line"))
    return no.brief(c, "user_id", 40).drop("line")
