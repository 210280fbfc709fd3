"""Verification, review, signal and graph-channel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import signals as sg
from memlake.operators import channel as ch
from memlake.operators import review as rv
from memlake.operators import verify as ve
from memlake.operators import writes as wr
from memlake.registry import register, table
from memlake.sources.transcripts import parse_transcript

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


@query(r"""WITH e AS (SELECT s_suppkey AS entity_id, unnest(string_split(lower(s_name || ' ' || n_name), ' ')) AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey),
q AS (SELECT n_nationkey AS query_id, unnest(string_split(lower('notes on ' || n_name), ' ')) AS w FROM nation),
a AS (SELECT DISTINCT query_id, entity_id FROM q JOIN e USING (w) WHERE w <> ''), m AS (SELECT DISTINCT l_suppkey AS entity_id, l_orderkey AS id FROM lineitem),
live AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), h1 AS (SELECT DISTINCT query_id, id FROM a JOIN m USING (entity_id) WHERE id IN (SELECT id FROM live)),
l AS (SELECT o_orderkey AS src, o_orderkey + k AS dst, ((o_orderkey * 7 + k * 13) % 100) / 100.0::DOUBLE AS similarity FROM orders, range(1, 9) r(k)),
b AS (SELECT src, dst FROM l WHERE similarity > .5 AND dst IN (SELECT id FROM live) QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 5),
u AS (SELECT query_id, id, 1 AS hop FROM h1 UNION ALL SELECT query_id, b.dst, 2 FROM h1 JOIN b ON b.src = h1.id), g AS (SELECT query_id, id, min(hop) AS hop FROM u GROUP BY 1, 2)
SELECT query_id, id, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS rank FROM g QUALIFY rank <= 60""")
def entity_graph_channel(spark, sf_dir):
    """A query per nation over suppliers as entities and orders as notes; the 60 best of each."""
    nation, orders = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    entities = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entity_id"), F.concat_ws(" ", "s_name", "n_name").alias("name"))
    asked = ch.query_entities(nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("notes on "), "n_name").alias("q")), entities)
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("id"))
    links = orders.select(F.col("o_orderkey").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("k")).select(
        "src", (F.col("src") + F.col("k")).alias("dst"), (((F.col("src") * 7 + F.col("k") * 13) % 100) / 100.0).alias("similarity"))
    live = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return ch.graph_channel(asked, mentions, links, live, 60)


@query(r"""SELECT event_id, CASE WHEN s IS NULL AND k IS NULL AND g IS NULL THEN CASE WHEN event_id % 7 = 0 THEN 'linked neighbour (spreading activation)' ELSE 'fused candidate' || tail END ELSE array_to_string(list_filter([
CASE WHEN s IS NOT NULL THEN 'semantic match ' || CASE WHEN m IS NULL THEN '' ELSE printf('%.2f ', m) END || '(rank ' || s || ')' END, 'keyword match (rank ' || k || ')', 'entity-graph link (rank ' || g || ')'],
lambda x: x IS NOT NULL), ' + ') || tail END AS why FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS s, CASE WHEN event_id % 4 = 0 THEN round((event_id % 101) / 100.0, 2)::DOUBLE END AS m,
CASE WHEN event_id % 3 = 0 THEN user_id + 1 END AS k, CASE WHEN event_id % 5 = 0 THEN user_id + 2 END AS g, CASE WHEN event_id % 6 = 1 THEN printf('; reranked %.2f', (event_id % 50 / 50.0)::DOUBLE) ELSE '' END AS tail FROM events)""")
def hit_reasons(spark, sf_dir):
    """why each of a set of made hits was found."""
    i, u = F.col("event_id"), F.col("user_id")
    why = sg.explain_hit(F.when(i % 2 == 0, u), F.when(i % 4 == 0, F.round((i % 101) / 100.0, 2)), F.when(i % 3 == 0, u + 1), F.when(i % 5 == 0, u + 2), F.when(i % 6 == 1, (i % 50) / 50.0), i % 7 == 0)
    return table(spark, sf_dir, "events").select("event_id", why.alias("why"))


_T = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: regexp_replace(t, '^[,;:?!)(\"'']+|[,;:?!)(\"'']+$', '', 'g')), lambda t: t <> '')"
_PATH = sg.FILE_PATH.replace("\\A", "^").replace("\\z", "$")
_SYMBOL = sg.CODE_SYMBOL.replace("\\A", "^").replace("\\z", "$")
_FILLER = ", ".join(f"'{w}'" for w in sg.FILLER)


@query(rf"""WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS p, {_T} AS t FROM conversations),
y AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(p), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 4 AND w NOT IN ({_FILLER})))::INT AS contentful,
len(list_filter(t, lambda w: regexp_matches(w, '{_PATH}'))) > 0 AS file_path, len(list_filter(t, lambda w: NOT regexp_matches(w, '{_PATH}') AND strlen(w) >= 3 AND regexp_matches(w, '{_SYMBOL}'))) > 0 AS code_symbol,
regexp_matches(lower(p), '{sg.ERROR_SIGNS}') AS error_string FROM x)
SELECT conv_id, turn, contentful, contentful < 2 AND NOT (file_path OR code_symbol OR error_string) AS vague, file_path, code_symbol, error_string FROM y""")
def prompt_signals(spark, sf_dir):
    """contentful words and signals of each turn."""
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", sg.prompt_quality(F.col("text")).alias("q"))
    return q.select("conv_id", "turn", "q.contentful", "q.vague", *[F.array_contains("q.signals", s).alias(s) for s in ("file_path", "code_symbol", "error_string")])


@query("SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') OR NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'skipped' ELSE 'text' END AS status, CASE WHEN status = 'text' THEN role END AS role, CASE WHEN status = 'text' THEN md5(text) END AS text_md5 FROM conversations")
def transcript_records(spark, sf_dir):
    """Turns written as transcript lines, every other one in blocks, and parsed again."""
    c = table(spark, sf_dir, "conversations")
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    lines = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, plain).otherwise(F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", block.alias("content")).alias("message")))).alias("value"))
    return parse_transcript(lines).select("conv_id", "turn", "status", "role", F.md5("text").alias("text_md5"))


@query()
def protected_tokens(spark, sf_dir):
    """each document's protected tokens."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(ve.protected_tokens("text")).alias("p"))
    return found.select("doc_id", F.substring_index("p", ":", 1).alias("token_class"), F.expr("substr(p, instr(p, ':') + 1)").alias("token"))


@query()
def curator_gates(spark, sf_dir):
    """V4: every turn claimed as a fact of its own first words, with itself as the evidence."""
    c = table(spark, sf_dir, "conversations")
    sentences = c.select(F.col("conv_id").alias("unit_id"), F.col("turn").cast("int").alias("sid"), "text", "role", F.lit(True).alias("cite_ok"), (F.octet_length("text") > 4000).alias("over_cap"))
    yes, no = F.lit(True), F.lit(False)
    words = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 8), " ")
    claims = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("candidate_id"), F.col("conv_id").alias("unit_id"), F.left(words, F.lit(90)).alias("statement"), F.lit("talk").alias("subject"), F.lit("fact").alias("claim_type"),
        F.col("role").alias("source_role"), F.lit("room").alias("room"), F.array(F.concat(F.lit("S"), F.col("turn").cast("string"))).alias("evidence"), yes.alias("index_available"), yes.alias("in_scope"),
        yes.alias("evidence_bound"), no.alias("private"), F.lit("direct").alias("authorship"))
    return ve.verify(claims, sentences, spark.createDataFrame([], "key string, state string"))


STATES = ["unreviewed", "unreviewed", "approved", "rejected"]


@query(r"""WITH p AS (SELECT user_id AS proposal_id, CASE user_id % 4 WHEN 2 THEN 'approved' WHEN 3 THEN 'rejected' ELSE 'unreviewed' END AS st FROM events GROUP BY 1),
d AS (SELECT event_id, user_id + (CASE WHEN event_id % 97 = 0 THEN 1000000 ELSE 0 END) AS proposal_id, event_id % 3 <> 0 AS ok, event_id % 5 = 0 AS ed, event_id % 10 <> 0 AS fits FROM events),
x AS (SELECT d.*, st, CASE WHEN NOT ok THEN 'rejected' WHEN ed THEN 'edited' ELSE 'approved' END AS tg FROM d LEFT JOIN p USING (proposal_id)),
y AS (SELECT *, min(CASE WHEN fits THEN event_id END) OVER w AS f, arg_min(tg, event_id) FILTER (fits) OVER w AS ft FROM x WINDOW w AS (PARTITION BY proposal_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
z AS (SELECT *, CASE WHEN st = 'unreviewed' THEN ft ELSE st END AS s2 FROM y)
SELECT event_id AS decision_id, proposal_id, CASE WHEN st IS NULL THEN 'unknown' WHEN st = 'unreviewed' AND fits AND event_id = f THEN 'applied' WHEN s2 = tg THEN 'repeated' ELSE 'refused' END AS outcome,
CASE WHEN st IS NOT NULL THEN coalesce(s2, 'unreviewed') END AS review_status FROM z""")
def proposal_decisions(spark, sf_dir):
    """Users as proposals and their events as decisions."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("user_id") % 4 + 1).cast("int"))
    proposals = e.select(F.col("user_id").alias("proposal_id"), state.alias("review_status"), F.array(F.lit("body")).alias("fields")).distinct()
    edits = F.when(i % 10 == 0, F.create_map(F.lit("other"), F.lit("x"))).when(i % 5 == 0, F.create_map(F.lit("body"), F.lit("x")))
    made = e.select(i.alias("decision_id"), (F.col("user_id") + F.when(i % 97 == 0, 1000000).otherwise(0)).alias("proposal_id"), (i % 3 != 0).alias("approve"), edits.alias("edits"))
    return rv.decide(proposals, made).drop("idempotency_key")


LEDGER = ["completed", "deferred", "expired_visible", "pending", "permanently_rejected", "skipped_disabled"]
_L = "[" + ", ".join(f"'{s}'" for s in LEDGER) + "]"


@query(f"""WITH u AS (SELECT user_id AS k, {_L}[user_id % 6 + 1] AS s, user_id % 3 AS a FROM events WHERE user_id % 5 <> 0 GROUP BY 1), a AS (SELECT user_id AS k, {_L}[event_id % 6 + 1] AS s, event_id AS t FROM events),
l AS (SELECT k, arg_max(s, t) AS last, bool_or(s = 'deferred') AS was, count(*) AS n FROM a GROUP BY k), x AS (SELECT u.k AS uk, s AS us, n, coalesce(a > 0, false) AS tried, coalesce(was, false) AND NOT coalesce(a > 0, false) AS o,
CASE WHEN coalesce(a > 0, false) THEN s WHEN coalesce(was, false) THEN last END AS s FROM u FULL JOIN l ON u.k = l.k),
c AS (SELECT count(s) AS ever_deferred, count_if(s IN ('completed', 'permanently_rejected'))::BIGINT AS recovered, count_if(s = 'expired_visible')::BIGINT AS expired, count_if(s IN ('pending', 'deferred'))::BIGINT AS immature,
count_if(s = 'skipped_disabled')::BIGINT AS skipped_disabled, count_if(us = 'deferred')::BIGINT AS backlog, count(uk) AS ledger_units, sum(n)::BIGINT AS audit_lines, count_if(o)::BIGINT AS audit_only FROM x)
SELECT *, recovered / nullif(recovered + expired, 0) AS recovery_rate, expired / nullif(recovered + expired, 0) AS expiry_rate FROM c""")
def curator_metrics(spark, sf_dir):
    """Users as units and their events as the log; some units only the log knows."""
    e = table(spark, sf_dir, "events")
    name = lambda c: F.element_at(F.array(*[F.lit(s) for s in LEDGER]), (F.col(c) % 6 + 1).cast("int")).alias("status")
    units = e.where(F.col("user_id") % 5 != 0).select(F.col("user_id").alias("unit_key"), name("user_id"), (F.col("user_id") % 3).alias("attempts")).distinct()
    return rv.ledger_metrics(units, e.select(F.col("user_id").alias("unit_key"), name("event_id"), F.col("event_id").alias("at")))


@query("""WITH n AS (SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders), w AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END AS id FROM lineitem WHERE l_returnflag = 'R')
SELECT w.id, CASE WHEN n.id IS NULL THEN 'not_found' WHEN kind = '1-URGENT' THEN 'unchanged' ELSE 'updated' END AS status FROM w LEFT JOIN n USING (id)""")
def bulk_set_kind(spark, sf_dir):
    """Orders as notes, returned lines name those to set."""
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    wanted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10000000).otherwise(0)).alias("id"))
    return wr.set_kind(notes, wanted, "1-URGENT")
