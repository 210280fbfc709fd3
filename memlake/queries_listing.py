"""Listings, counters, eligibility and secrets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import ingest as ing
from memlake.operators import lineage as ln
from memlake.operators import listing as ls
from memlake.operators import verify as ve
from memlake.registry import register, table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

NOTES = """n AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || (o_orderkey % 4000)::VARCHAR AS title, o_orderstatus || repeat('x', (o_orderkey % 150)::INT) AS content, o_totalprice AS strength, o_orderkey % 7 AS access_count,
CASE WHEN o_orderkey % 3 = 0 THEN 'observation' ELSE 'note' END AS kind, o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP AS updated_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS state FROM orders)"""


def _notes(spark, sf_dir):
    """Orders as notes."""
    i, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        i.alias("id"), F.concat_ws(" ", "o_orderpriority", (i % 4000).cast("string")).alias("title"), F.concat(s, F.repeat(F.lit("x"), (i % 150).cast("int"))).alias("content"), F.col("o_totalprice").alias("strength"),
        (i % 7).alias("access_count"), F.when(i % 3 == 0, "observation").otherwise("note").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.when(s != "P", s).alias("state"), F.lit(None).cast("string").alias("agent_id"))


@query(f"WITH {NOTES} SELECT id, title FROM n ORDER BY updated_at DESC NULLS LAST, id LIMIT 100")
def recent_notes(spark, sf_dir):
    """K1: the hundred last updated, a top-k report."""
    return ls.recent(_notes(spark, sf_dir), 100).select("id", "title")


@query(f"WITH {NOTES} SELECT id, round(strength, 2) AS strength, access_count FROM n ORDER BY n.strength DESC NULLS LAST, access_count DESC, id LIMIT 5")
def session_start_top5(spark, sf_dir):
    """K3: a top-k report."""
    return ls.session_start(_notes(spark, sf_dir)).select("id", F.round("strength", 2).alias("strength"), "access_count")


@query(f"""WITH {NOTES} SELECT 'stub' AS category, id FROM n WHERE length(content) < 100 AND access_count <= 1
UNION ALL SELECT 'test_title', id FROM n WHERE regexp_matches(lower(title), '^(1-urgent|5-low) 7')
UNION ALL SELECT 'never_read', id FROM n WHERE kind = 'observation' AND access_count = 0 AND created_at < TIMESTAMP '1996-01-01' - INTERVAL 7 DAY
UNION ALL SELECT 'duplicate_title', id FROM n WHERE lower(title) IN (SELECT lower(title) FROM n GROUP BY 1 HAVING count(*) > 1)""")
def clutter_of_notes(spark, sf_dir):
    """K4 with a title pattern that the titles can meet."""
    return ls.clutter(_notes(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"), test_title="^(1-urgent|5-low) 7")


@query(f"WITH {NOTES} SELECT coalesce(state, 'fresh') AS state, count(*) AS memories, sum(length(content))::BIGINT AS chars FROM n GROUP BY 1")
def status_of_notes(spark, sf_dir):
    """A2 by state."""
    return ls.status_counts(_notes(spark, sf_dir))


@query("SELECT 'memories' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM embeddings UNION ALL SELECT 'links', count(*) FROM lineitem")
def status_totals(spark, sf_dir):
    """A2: totals of tables."""
    return ls.status_totals(memories=table(spark, sf_dir, "documents"), chunks=table(spark, sf_dir, "embeddings"), links=table(spark, sf_dir, "lineitem"))


@query(f"WITH {NOTES} SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = n.id AND l_returnflag = 'R')")
def consolidate_queue(spark, sf_dir):
    """Orders without a returned line."""
    return ls.consolidate_queue(_notes(spark, sf_dir), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_id"))).select("id")


@query("""WITH v AS (SELECT l_orderkey AS id, l_linenumber AS version, repeat('v', (max(l_partkey) % 600)::INT) AS content FROM lineitem GROUP BY 1, 2)
SELECT id, version, (row_number() OVER (PARTITION BY id ORDER BY version DESC))::INT AS place, content[1:280] AS preview, length(content)::INT AS chars FROM v""")
def version_previews(spark, sf_dir):
    """K5: lines as versions of their order; no order has more than seven."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version")).agg(F.max("l_partkey").alias("p"))
    v = v.select("id", "version", F.expr("repeat('v', cast(p % 600 as int))").alias("content"))
    return ls.version_list(v)


_EVENTS = """e AS (SELECT event_id, event_type AS kind, CASE user_id % 10 WHEN 0 THEN 'a/Private/x.md' WHEN 1 THEN 'a/privateer.md' WHEN 2 THEN NULL ELSE 'b/x.md' END AS path FROM events),
k AS (SELECT list_sort(list(DISTINCT kind)) AS t FROM e),
j AS (SELECT event_id, CASE WHEN kind = t[1] THEN 'curator_output' WHEN coalesce(regexp_matches(path, '(?i)(^|[/\\\\])\\.?private([/\\\\]|$)'), false) THEN 'private' WHEN kind = t[2] THEN 'not_allowed' ELSE 'eligible' END AS reason FROM e, k)"""


def _judged(spark, sf_dir):
    u = F.col("user_id") % 10
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.when(u == 0, "a/Private/x.md").when(u == 1, "a/privateer.md").when(u == 2, None).otherwise("b/x.md").alias("path"))
    kinds = [r["kind"] for r in e.select("kind").distinct().orderBy("kind").collect()]  # a handful of types
    return ln.eligibility(e, kinds[2:], kinds[:1])


@query(f"WITH {_EVENTS} SELECT event_id, reason FROM j")
def event_eligibility(spark, sf_dir):
    """P6, P8."""
    return _judged(spark, sf_dir).select("event_id", "reason")


@query(f"WITH {_EVENTS} SELECT reason, count(*) AS n FROM j WHERE reason <> 'eligible' GROUP BY 1")
def ineligible_reasons(spark, sf_dir):
    """A10."""
    return ln.ineligible_counts(_judged(spark, sf_dir))


def _lit(pattern: str) -> str:
    """A pattern as SQL text; the other engine takes (?s) and the rest as they are."""
    return "'" + pattern.replace("'", "''") + "'"


_LONG = f"""lt AS (SELECT doc_id, tok, regexp_matches(tok, '[0-9]') AND regexp_matches(tok, '[A-Za-z]') AS mixed, regexp_full_match(tok, '[0-9a-fA-F]{{32,}}') AS hex FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_lit(ve.LONG_TOKEN)})) AS tok FROM documents)),
en AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, tok, hex, -sum(n / length(tok) * log2(n / length(tok))) AS bits FROM (SELECT doc_id, tok, hex, c, count(*) AS n FROM (SELECT DISTINCT doc_id, tok, hex FROM lt WHERE mixed) x, unnest(string_split(tok, '')) u(c) GROUP BY ALL) GROUP BY ALL) WHERE bits >= 3.5 OR hex)"""


@query(f"WITH {_LONG} SELECT d.doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, {_lit(p)}) THEN '{c}'" for c, p in ve.SENSITIVE) + " WHEN en.doc_id IS NOT NULL THEN 'high_entropy' END AS sensitive FROM documents d LEFT JOIN en ON en.doc_id = d.doc_id")
def sensitive_classes(spark, sf_dir):
    """the first class of what must not be kept, of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", ve.sensitive_class(F.col("text")).alias("sensitive"))


@query("SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, {_lit(p)}), false) AS p{i}_{c}" for i, (c, p) in enumerate(tx.SECRET_PATTERNS)) + " FROM documents")
def secret_flags(spark, sf_dir):
    """one flag for each pattern of the redaction."""
    return table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(F.col("text").rlike(p), F.lit(False)).alias(f"p{i}_{c}") for i, (c, p) in enumerate(tx.SECRET_PATTERNS)])


@query("""SELECT o_orderkey AS id, 1 AS fact_no, 'order status' AS subject, '' AS attribute, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END AS value,
substr(sha256('order status' || chr(0) || '' || chr(0) || CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END), 1, 16) AS fact_id FROM orders WHERE o_orderkey % 2 = 0""")
def facts_of_orders(spark, sf_dir):
    """every other order's state told in a sentence."""
    s, i = F.col("o_orderstatus"), F.col("o_orderkey")
    state = F.when(s == "F", "finished").when(s == "O", "open").otherwise("partial")
    told = F.when(i % 2 == 0, F.concat(F.lit("Hello there. My order status is now "), state, F.lit("."))).otherwise(F.lit("Nothing to tell here."))
    return ing.extract_facts(table(spark, sf_dir, "orders").select(i.alias("id"), told.alias("content")))


@query("""SELECT c_custkey AS id, 1 AS pref_no, 'I prefer the segment ' || lower(c_mktsegment) AS sentence FROM customer WHERE c_custkey % 2 = 0""")
def preferences_of_customers(spark, sf_dir):
    """every other customer states a preference."""
    told = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Good day. I prefer the segment "), F.lower("c_mktsegment"), F.lit(". It was so."))).otherwise(F.lit("We met on a good day in spring."))
    return ing.extract_preferences(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), told.alias("content")))
