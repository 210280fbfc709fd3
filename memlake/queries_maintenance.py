"""Rebuilding, trash, playbook rules, ambient runs, transcripts and offline scoring over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import ambient as am
from memlake.operators import rebuild as rb
from memlake.operators import redact as rd
from memlake.operators import scoring as sc
from memlake.operators.store import NoteStore
from memlake.plans.shared import SharedStage
from memlake.registry import register, table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

NOW = "2024-01-20 12:00:00"


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 10 <> 0 AS live FROM part), l AS (SELECT id FROM p WHERE live),
m AS (SELECT id AS src, id // 3 AS dst, 'uses' AS link_type FROM l UNION SELECT id, id * 2, 'manual' FROM l)
SELECT src, dst, link_type FROM m WHERE src <> dst AND dst IN (SELECT id FROM l) UNION ALL SELECT id, id + 1, 'entity' FROM p""")
def rebuilt_wikilinks(spark, sf_dir):
    """Parts as notes that name two others; the links that entities make stay."""
    i = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("Part "), c.cast("string"))
    content = F.concat(F.lit("see [["), name(F.floor(i / 3)), F.lit("|Uses]], [["), name(i * 2), F.lit("]] and [["), name(i), F.lit("]]"))
    parts = table(spark, sf_dir, "part")
    notes = parts.select(i.alias("id"), F.concat(F.lit("p"), i.cast("string"), F.lit(".md")).alias("filename"), name(i).alias("title"), content.alias("content"), F.when(i % 10 == 0, "dormant").otherwise("fresh").alias("state"))
    old = parts.select(i.alias("src"), (i + 1).alias("dst"), F.lit("entity").alias("link_type"), F.lit(0.7).alias("similarity"), F.lit(False).alias("from_text"))
    stale = parts.select(i.alias("src"), (i + 2).alias("dst"), F.lit("manual").alias("link_type"), F.lit(1.0).alias("similarity"), F.lit(True).alias("from_text"))
    return rb.rebuild_wikilinks(notes, old.unionByName(stale)).select("src", "dst", "link_type")


@query("""WITH n AS (SELECT c_custkey AS id, c_custkey % 99 AS f, c_custkey % 3 = 0 AS gone FROM customer), w AS (SELECT id FROM n WHERE id % 2 = 0 UNION ALL SELECT id + 100000000 FROM n WHERE id % 20 = 0),
h AS (SELECT DISTINCT f FROM n WHERE NOT gone), k AS (SELECT w.id, n.id AS known, n.f, gone, h.f AS taken FROM w LEFT JOIN n ON n.id = w.id LEFT JOIN h ON h.f = n.f), b AS (SELECT max(id) AS id FROM k WHERE gone AND taken IS NULL GROUP BY f)
SELECT id, CASE WHEN known IS NULL THEN 'not_found' WHEN NOT gone THEN 'not_in_trash' WHEN id IN (SELECT id FROM b) THEN 'restored' ELSE 'name_taken' END AS status FROM k""")
def trash_restored(spark, sf_dir):
    """A third of the customers' notes is thrown away and every other one is asked back."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    notes = c.select(i.alias("id"), (i % 99).cast("string").alias("filename"), F.col("c_name").alias("title"), F.lit("").alias("content"), F.lit("fresh").alias("state"), F.lit(None).cast("timestamp").alias("deleted_at"))
    thrown = rb.trash(notes, notes.where("id % 3 = 0"), F.lit(NOW).cast("timestamp"))
    wanted = notes.where("id % 2 = 0").select("id").unionByName(notes.where("id % 20 = 0").select((F.col("id") + 100000000).alias("id")))
    return rb.restore(thrown, wanted)[1]


@query(r"""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'short' ELSE 'Always ship ' || o_orderpriority || ' orders (like ' || o_orderkey || ') by the end of the very same working day' END AS rule, CASE WHEN o_orderkey % 3 > 0 THEN 'room' || (o_orderkey % 3) END AS room FROM orders),
t AS (SELECT *, 'Rule: ' || left(rule, 60) AS title FROM o WHERE strlen(rule) >= 8)
SELECT id, coalesce(room || '/', '') || 'playbook/' || left(trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '-'), 48) || '-' || left(sha256(id || chr(1) || rule), 8) || '.md' AS filename, title, kind, after,
'---' || chr(10) || 'nv_type: playbook_rule' || chr(10) || coalesce('scope: ' || room || chr(10), '') || 'category: framing' || chr(10) || 'source: user_correction' || chr(10) || 'importance: high' || chr(10) || 'confidence: 0.95' || chr(10)
|| 'last_confirmed_at: 2024-01-20T12:00:00Z' || chr(10) || '---' || chr(10) || '# ' || title || chr(10) || chr(10) || rule || chr(10) AS content FROM (SELECT *, 'preference' AS kind, left(rule, 160) AS after FROM t)""")
def playbook_notes(spark, sf_dir):
    """M8: a correction for each order."""
    i = F.col("o_orderkey")
    rule = F.when(i % 50 == 0, "short").otherwise(F.concat(F.lit("Always ship "), "o_orderpriority", F.lit(" orders (like "), i.cast("string"), F.lit(") by the end of the very same working day")))
    room = F.when(i % 3 > 0, F.concat(F.lit("room"), (i % 3).cast("string")))
    corrections = table(spark, sf_dir, "orders").select(i.alias("id"), rule.alias("rule"), room.alias("room"), F.lit(None).cast("string").alias("title"))
    return rb.playbook_rules(corrections, F.lit(NOW).cast("timestamp")).select("id", "filename", "title", "kind", "after", "content")


@query()
def ambient_decisions(spark, sf_dir):
    """M5: every turn as a prompt, some with an intent forced on them; candidates and scores come from its ids."""
    i = F.xxhash64("conv_id", "turn")
    forced = F.when(F.pmod(i, F.lit(10)) == 0, "temporal_diff").when(F.pmod(i, F.lit(10)) == 1, "draft_output")
    turns = table(spark, sf_dir, "conversations").select(
        i.alias("query_id"), F.col("text").alias("prompt"), F.lit(True).alias("enabled"), F.lit(False).alias("fresh_state"), forced.alias("forced")).dropDuplicates(["query_id"])
    each = turns.select("query_id", F.explode(F.array(*[F.lit(n) for n in range(1, 5)])).alias("id"))
    ce = F.pmod(F.xxhash64("query_id", "id"), F.lit(100)) / 100.0
    line = F.concat(F.lit("memory "), F.col("id").cast("string"))
    hits = each.select("query_id", "id", ce.alias("ce"), (F.col("id") == 4).alias("strong"), (F.col("id") == 1).alias("excluded"), line.alias("line"))
    sections = each.where("id < 4").select("query_id", F.col("id").alias("section"), "id", F.lit(1).alias("rank"), ce.alias("ce"), F.lit(0.5).alias("salience"), F.lit(True).alias("live"), line.alias("line"))
    changes = each.select("query_id", F.col("id").alias("change_id"), F.lit("note_updated").alias("change_type"), ce.alias("importance"), line.alias("line"))
    return am.ambient(spark, turns, changes, sections, hits).decisions


@query()
def transcript_lines(spark, sf_dir):
    """Conversations as transcripts, redacted, cut and shown."""
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    record = F.to_json(F.struct(role.alias("type"), F.struct(role.alias("role"), F.col("text").alias("content")).alias("message")))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", record.alias("value"))
    return rd.render(rd.transcript_sentences(lines, "conv_id", "turn"), ["conv_id", "part"])


def _scored(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    words = F.split("text", " ")
    said = c.select(F.col("conv_id").alias("unit_id"), F.col("turn").alias("proposal_no"), F.col("text").alias("statement"))
    gold = c.select(F.col("conv_id").alias("unit_id"), F.col("turn").alias("gold_no"), F.col("text").alias("statement"), F.slice(words, F.lit(1), (F.col("turn") % 3 + 1).cast("int")).alias("terms"))
    return sc.unit_scores(said, gold)


@query()
def offline_scores(spark, sf_dir):
    """Turns as proposals, and the first words of turns as what they should state."""
    return _scored(spark, sf_dir)


@query()
def bootstrap_precision(spark, sf_dir):
    """Precision of those proposals with its interval."""
    return sc.bootstrap_interval(_scored(spark, sf_dir), "matched", "proposals")


@query()
def graph_cache_key(spark, sf_dir):
    """The key of the graph of customers and the nations that they belong to."""
    c = table(spark, sf_dir, "customer")
    return rb.graph_key(c.select(F.col("c_custkey").alias("id")), c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")))


@query("""WITH d AS (SELECT doc_id, 'docs/doc-' || doc_id || '.md' AS filename, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, filename, CASE WHEN doc_id % 4 = 2 THEN t || ' edited' ELSE t END AS content, CASE WHEN doc_id % 8 = 0 AND doc_id % 16 <> 0 THEN 'dormant' ELSE 'fresh' END AS state FROM d)
SELECT filename, state, sha256(content) AS content_hash, (CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END)::BIGINT AS versions, (state = 'fresh' AND trim(content) <> '')::BIGINT AS document_chunks FROM n""")
def note_store_batches(spark, sf_dir):
    """S5, S13, T-7: the stored tables after four batches of changed files, the second one applied twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), F.coalesce("text", F.lit("")).alias("text"))
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("changed_at")
    rows = lambda which, text, removed, day: docs.where(which).select("filename", text.alias("content"), F.lit(removed).alias("removed"), at(day))
    text, edited = F.col("text"), F.concat("text", F.lit(" edited"))
    store = NoteStore(spark, SharedStage(spark, "store").path("notes"), buckets=8)
    second = rows("doc_id % 4 = 2", text, False, 2).unionByName(rows("doc_id % 4 = 2", edited, False, 3)).unionByName(rows("doc_id % 4 = 3", text, False, 2))
    for batch, changes in enumerate([rows("doc_id % 4 <> 3", text, False, 1), second, second, rows("doc_id % 8 = 0", text, True, 4).unionByName(rows("doc_id % 4 = 1", text, False, 4)), rows("doc_id % 16 = 0", text, False, 5)]):
        store.apply(changes, batch if batch < 2 else batch - 1)
    versions = store.read("versions").groupBy("id").agg(F.count(F.lit(1)).alias("versions"))
    chunks = store.read("chunks").where("granularity = 'document'").groupBy("id").agg(F.count(F.lit(1)).alias("document_chunks"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return store.read("notes").join(versions, "id", "left").join(chunks, "id", "left").select("filename", "state", "content_hash", count("versions"), count("document_chunks"))
