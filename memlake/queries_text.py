"""Text, ingest, maintenance and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import gate as ga
from memlake.operators import ingest as ing
from memlake.operators import redact as rd
from memlake.operators import vector as ve
from memlake.operators import listing as lt
from memlake.plans.spread import spread_small
from memlake.registry import register, table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    """F7, S5."""
    return _docs(spark, sf_dir).groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


SENTENCES = r"list_filter(list_transform(flatten(list_transform(string_split_regex(regexp_replace({0}, '([.!?])[ \t]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: string_split(s, chr(10)))), lambda s: trim(s)), lambda s: s <> '')"


@query(f"WITH s AS (SELECT conv_id, turn, unnest({SENTENCES.format('text')}) AS sentence, generate_subscripts({SENTENCES.format('text')}, 1) - 1 AS pos FROM conversations) SELECT conv_id, turn, pos::INT AS pos, sentence FROM s")
def chunk_sentences(spark, sf_dir):
    """F4."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"""WITH s AS (SELECT conv_id, turn, {SENTENCES.format('text')} AS s FROM conversations),
w AS (SELECT conv_id, turn, unnest(range(len(s))) AS i, s FROM s), x AS (SELECT conv_id, turn, i, array_to_string(s[greatest(i, 1):i + 2], ' ') AS t FROM w)
SELECT conv_id, turn, i::INT AS i, t AS window_text FROM x WHERE len(list_filter(string_split_regex(t, '\\s+'), lambda z: z <> '')) >= 6""")
def sentence_windows(spark, sf_dir):
    """windows of three sentences with six words or more."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.split_sentences(F.col("text")).alias("s"))
    made = F.transform("s", lambda x, i: F.array_join(F.slice("s", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "))
    out = t.select("conv_id", "turn", F.posexplode(made).alias("i", "window_text"))
    return out.where(F.size(F.filter(F.split("window_text", r"\s+"), lambda w: w != "")) >= 6)


@query()
def chunk_documents(spark, sf_dir):
    """all chunks of all documents."""
    return ing.chunk_notes(_docs(spark, sf_dir).withColumnsRenamed({"doc_id": "id", "text": "content"})).drop("embed_text")


@query()
def entities_of_documents(spark, sf_dir):
    """F9."""
    return ing.extract_entities(_docs(spark, sf_dir), "doc_id", "text")


@query()
def facts_of_turns(spark, sf_dir):
    """F10, F11."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    return ing.extract_facts(turns)


@query()
def preferences_of_turns(spark, sf_dir):
    """F12."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    return ing.extract_preferences(turns)


_FLAGS = {
    "aws_access_key_id": r"(^|[^A-Za-z0-9_])(AKIA|ASIA)[0-9A-Z]{16}($|[^A-Za-z0-9_])",
    "github_token": r"(^|[^A-Za-z0-9_])(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,}($|[^A-Za-z0-9_])",
    "key_value_secret": r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*[\"']?([^ \t\n\r\"',;]{6,})",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}($|[^0-9.])",
    "long_hex": r"(^|[^A-Za-z0-9])[0-9a-f]{32,}($|[^A-Za-z0-9])",
}

#: What a text must hold for a flag, quick to look for.
_NEEDS = {"aws_access_key_id": "AKIA|ASIA", "github_token": "gh[pousr]_", "email": "@"}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') AS {n}" for n, p in _FLAGS.items()) + " FROM documents")
def redact_flags(spark, sf_dir):
    """one flag per class of secret or personal data."""
    text = F.col("text")
    told = {n: text.rlike(p) if n not in _NEEDS else F.when(text.isNotNull(), text.rlike(_NEEDS[n]) & text.rlike(p)) for n, p in _FLAGS.items()}
    return spread_small(_docs(spark, sf_dir)).select("doc_id", *[f.alias(n) for n, f in told.items()])


@query()
def redact_text(spark, sf_dir):
    """texts with secrets replaced, and the spans by class."""
    return rd.redact(_docs(spark, sf_dir).select("doc_id", "text"), "text")


@query()
def segment_turns(spark, sf_dir):
    """Citable sentences of every turn."""
    return rd.segment(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@query("""WITH s AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT CASE WHEN toxic = 1 THEN 'dormant' WHEN toxic = 0 THEN 'active' ELSE 'fresh' END AS state, count(*) AS memories, sum(length(text))::BIGINT AS chars FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1""")
def status_breakdown(spark, sf_dir):
    """A2: counts by state, one pass; unlabelled documents have no state."""
    states = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    state = F.when(F.col("toxic") == 1, "dormant").when(F.col("toxic") == 0, "active")
    return lt.status_counts(_docs(spark, sf_dir).join(states, "doc_id", "left").select(state.alias("state"), F.col("text").alias("content")))


@query("""WITH d AS (SELECT doc_id, text, lower(trim(string_split(text, chr(10))[1])) AS title FROM documents)
SELECT 'stub' AS category, doc_id FROM d WHERE length(coalesce(text, '')) < 100 AND doc_id % 3 <= 1
UNION ALL SELECT 'test_title', doc_id FROM d WHERE regexp_matches(title, '^(the|test)')
UNION ALL SELECT 'never_read', doc_id FROM d WHERE doc_id % 3 = 0 AND doc_id % 2 = 0
UNION ALL SELECT 'duplicate_title', doc_id FROM d WHERE title <> '' AND title IN (SELECT title FROM d GROUP BY title HAVING count(*) > 1)""")
def clutter_report(spark, sf_dir):
    """K4: stubs, test titles, observations never read and shared titles; every third document is unread, every second an old observation."""
    i, now = F.col("doc_id"), F.lit("2024-02-01").cast("timestamp")
    notes = _docs(spark, sf_dir).select(
        i.alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("content"), (i % 3).alias("access_count"),
        F.when(i % 2 == 0, "observation").otherwise("note").alias("kind"), (now - F.expr("INTERVAL 30 DAYS")).alias("created_at"))
    return lt.clutter(notes, now, test_title="^(the|test)").withColumnRenamed("id", "doc_id")


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def consolidate_queue_anti(spark, sf_dir):
    """Notes that nothing has been derived from."""
    notes = _docs(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return lt.consolidate_queue(notes, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"))).select(F.col("id").alias("doc_id"), "n_chars")


_KINDS = "CASE doc_id % 5 WHEN 0 THEN 'working_state' WHEN 1 THEN 'task' WHEN 2 THEN 'decision' WHEN 3 THEN 'preference' ELSE 'note' END"
_SALIENCE = f"""WITH s AS (SELECT doc_id, (doc_id % 400)::DOUBLE AS age, {_KINDS} AS kind, doc_id % 25 AS uses, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'normal' END AS importance FROM documents),
h AS (SELECT *, CASE kind WHEN 'working_state' THEN 2.0 WHEN 'task' THEN 14.0 WHEN 'decision' THEN 180.0 WHEN 'preference' THEN 365.0 ELSE 90.0 END AS half FROM s),
t AS (SELECT *, .25 * exp(-age / half * ln(2.0)) + .20 * least(ln(1.0 + uses) / ln(20.0), 1.0) + .20 * (CASE importance WHEN 'high' THEN 1.0 WHEN 'low' THEN .3 ELSE .6 END) + .15 * (doc_id % 10) / 10.0 + .10 * .5 + .10 * (doc_id % 4) / 3.0 AS total FROM h)"""


def _salience(spark, sf_dir):
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "working_state").when(i % 5 == 1, "task").when(i % 5 == 2, "decision").when(i % 5 == 3, "preference").otherwise("note")
    d = _docs(spark, sf_dir).select("doc_id", (i % 400).cast("double").alias("age"), kind.alias("kind"), (i % 25).alias("uses"),
                                    F.when(i % 3 == 0, "high").when(i % 3 == 1, "low").otherwise("normal").alias("importance"))
    return d.withColumn("total", tx.salience(F.col("age"), F.col("kind"), F.col("uses"), F.col("importance"), (i % 10) / 10.0, F.lit(0.5), (i % 4)))


@query(_SALIENCE + " SELECT doc_id, kind, round(total, 6) AS salience FROM t")
def salience_score(spark, sf_dir):
    """F35 over made-up usage."""
    return _salience(spark, sf_dir).select("doc_id", "kind", F.round("total", 6).alias("salience"))


@query(_SALIENCE + " SELECT doc_id, (total < .15 AND age > 90 AND uses = 0 AND importance = 'low') AS archive FROM t")
def archive_verdict(spark, sf_dir):
    """F36."""
    d = _salience(spark, sf_dir)
    return d.select("doc_id", tx.should_archive(F.col("total"), F.col("age"), F.col("uses"), F.col("importance")).alias("archive"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id % 7 DESC, doc_id LIMIT 5")
def session_top5(spark, sf_dir):
    """K3: a top-k report; length stands for strength."""
    i = F.col("doc_id")
    top = lt.session_start(_docs(spark, sf_dir).select(i.alias("id"), F.col("n_chars").alias("strength"), (i % 7).alias("access_count")))
    return top.select(F.col("id").alias("doc_id"), F.col("strength").alias("n_chars"))


_GATE_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id AS id, (1 + list_cosine_similarity(q.e, v.e)) / 2 AS ce, v.vec_id % 17 = 0 AS strong, q.vec_id % 3 = 0 AS vague FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ce, 9) DESC, id) AS rank FROM c QUALIFY rank <= 10),
t AS (SELECT *, max(CASE WHEN rank = 1 THEN ce END) OVER w AS top, max(CASE WHEN rank = 2 THEN ce END) OVER w AS second, bool_or(rank = 1 AND strong) OVER w AS tops FROM r WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT *, greatest(.60 + (CASE WHEN vague THEN .15 ELSE 0 END) - (CASE WHEN tops THEN .10 ELSE 0 END), .35) AS floor FROM t)
SELECT query_id, id, round(ce, 6) AS ce, round(floor::DOUBLE, 2) AS floor FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM f
WHERE top >= floor AND (tops OR top >= .80 OR second IS NULL OR top - second >= .04) AND ce >= floor - .10) WHERE k <= 3"""


@query(_GATE_SQL)
def ambient_gate(spark, sf_dir):
    """M1 over scores made from cosines."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = ve.knn(asked, vectors, 10, skip_self=True)
    cands = hits.select("query_id", "id", ((1 + F.col("similarity")) / 2).alias("ce"), (F.col("id") % 17 == 0).alias("strong"), (F.col("query_id") % 3 == 0).alias("vague"))
    return ga.gate(cands).select("query_id", "id", F.round("ce", 6).alias("ce"), F.round("floor", 2).alias("floor"))


def _intent_sql() -> str:
    quote = lambda p: p.replace("'", "''")
    cases = []
    for intent, _, phrases in tx.INTENTS:
        hits = " OR ".join(f"contains(t, '{quote(p)}')" for p in phrases)
        cases.append(f"WHEN {hits} THEN '{'general_question' if intent == 'continue_work' else intent}'")
    return f"SELECT conv_id, turn, CASE {' '.join(cases)} ELSE 'general_question' END AS intent FROM (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations)"


@query(_intent_sql())
def intent_router(spark, sf_dir):
    """F33 without fresh working state."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.route_intent(F.col("text"), F.lit(False)).alias("intent"))


@query("SELECT doc_id, CASE WHEN n_chars < 100 THEN 'insert' WHEN doc_id % 7 = 0 THEN 'revive' WHEN doc_id % 3 = 0 THEN 'update' ELSE 'skip' END AS action FROM documents")
def ingest_upsert_plan(spark, sf_dir):
    """Hashes of what is there against what comes in."""
    d = _docs(spark, sf_dir)
    name = F.col("doc_id").cast("string")
    old = F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 7 != 0), F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    current = d.where("n_chars >= 100").select(name.alias("filename"), tx.content_hash(old).alias("content_hash"), F.when(F.col("doc_id") % 7 == 0, "dormant").otherwise("fresh").alias("state"))
    plan = ing.upsert_plan(current, d.select(name.alias("filename"), F.col("text").alias("content")))
    return plan.select(F.col("filename").cast("long").alias("doc_id"), "action")
