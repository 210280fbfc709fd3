"""Retrieval queries: keyword, vector, fusion and re-scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import FRESH, HISTORICAL, STOPWORDS, TITLE_STOPWORDS, classify_query, extract_salient, temporal_intent
from memlake.operators import bm25 as kw
from memlake.operators import fusion as fu
from memlake.operators import recall as rc
from memlake.operators import vector as ve
from memlake.operators.similarity import equal_vectors, similar_pairs
from memlake.plans.shared import SharedStage
from memlake.registry import register, table

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TSTOP = ", ".join(f"'{w}'" for w in TITLE_STOPWORDS)


def _tok(c: str) -> str:
    return (f"list_filter(regexp_extract_all(regexp_replace(lower({c}), '[#*`\\[\\](){{}}|>~_]', ' ', 'g'), '[a-z0-9]+(?:-[a-z0-9]+)*'), "
            f"lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))")


def _batch(spark, sf_dir: str) -> DataFrame:
    """The query batch: every benchmark item's text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


_indexes: dict = {}


def _index(spark, sf_dir: str) -> kw.KeywordIndex:
    """The stored keyword index of the documents, built once per session and folder while its table stands."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes or not _indexes[key].stands():
        _indexes[key] = kw.KeywordIndex.build(table(spark, sf_dir, "documents"))
    return _indexes[key]


BM25_CTE = f"""
d AS (SELECT doc_id, {_tok('text')} AS t FROM documents),
nd AS (SELECT doc_id, t, len(t) AS dl FROM d WHERE len(t) > 0),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM nd),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM nd) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tok('q')}) AS term FROM qs) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(qtf * (CASE WHEN ln((n - df + .5) / (df + .5)) < 0 THEN .25 ELSE 1 END) * ln((n - df + .5) / (df + .5)) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * dl / avgdl))) AS score
       FROM qt JOIN df USING (term) JOIN tf USING (term), st GROUP BY ALL),
mx AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM sc WHERE score <> 0),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
       FROM mx WHERE best <= 0 OR score > 0.1 * best)
"""
ITEMS = "qs AS (SELECT item_id AS query_id, text AS q FROM benchmark)"


@query(f"WITH {ITEMS}, {BM25_CTE} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """R2: ten best documents for every benchmark item as a query."""
    hits = kw.bm25(_batch(spark, sf_dir), _index(spark, sf_dir), 10)
    return hits.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {ITEMS}, {BM25_CTE}, q1 AS (SELECT DISTINCT query_id, term FROM qt),
x AS (SELECT query_id, term, coalesce(df, 0) AS df, ln((n - coalesce(df, 0) + .5) / (coalesce(df, 0) + .5) + 1) AS idf FROM q1 LEFT JOIN df USING (term), st)
SELECT query_id, term, df, round(idf, 6) AS idf, round(max(idf) OVER (PARTITION BY query_id), 6) AS max_idf FROM x""")
def query_signal_idf(spark, sf_dir):
    """R27."""
    out = kw.query_signal(_batch(spark, sf_dir), _index(spark, sf_dir))
    return out.select("query_id", "term", "df", F.round("idf", 6).alias("idf"), F.round("max_idf", 6).alias("max_idf"))


@query(f"""WITH t AS (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""")
def token_stats(spark, sf_dir):
    """A1: document and corpus frequency of every term."""
    terms = _index(spark, sf_dir).postings()
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _asked(spark, sf_dir):
    """The stated query set of vector searches: ids divisible by 20."""
    return _vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


KNN_CTE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
kq AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS sim, list_distance(q.e, v.e) AS dist, v.label, q.label AS qlabel
       FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)"""


@query(f"""WITH {KNN_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM kq)
SELECT query_id, id, round(sim, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10""")
def knn_cosine_topk(spark, sf_dir):
    """R1."""
    hits = ve.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), 10, skip_self=True)
    return hits.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {KNN_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - dist, 9) DESC, id) AS rank FROM kq)
SELECT query_id, id, round(1 - dist, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10""")
def knn_one_minus_l2(spark, sf_dir):
    """R1 on the other similarity scale."""
    hits = ve.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), 10, metric="one_minus_l2", skip_self=True)
    return hits.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {KNN_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM kq)
SELECT query_id, id, round(sim, 6) AS similarity FROM r WHERE rank = 1 AND sim >= 0.35""")
def nearest_dup_threshold(spark, sf_dir):
    """Nearest other vector, if near enough."""
    hits = ve.near_matches(ve.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), 1, skip_self=True), 0.35)
    return hits.select("query_id", "id", F.round("similarity", 6).alias("similarity"))


EACH = "(SELECT min(vec_id) AS vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding)"  # equal vectors are one
PAIRS = f"SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM {EACH} a JOIN {EACH} b ON a.vec_id < b.vec_id"


@query(f"WITH p AS ({PAIRS}) SELECT a, b, round(s, 3) AS similarity FROM p WHERE s >= 0.38 AND s < 0.45")
def conflict_band_pairs(spark, sf_dir):
    """J6 with the band moved to where the test vectors lie."""
    return similar_pairs(_vectors(spark, sf_dir), 0.38, 0.45).select("a", "b", F.round("similarity", 3).alias("similarity"))


@query(f"""WITH p AS ({PAIRS}), b2 AS (SELECT a AS src, b AS dst, s FROM p WHERE s >= 0.3 UNION ALL SELECT b, a, s FROM p WHERE s >= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, dst) AS rank FROM b2)
SELECT src, dst, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5""")
def semantic_links_topk(spark, sf_dir):
    """Links above a similarity, five per source."""
    links = ve.top_links(similar_pairs(_vectors(spark, sf_dir), 0.3), 5)
    return links.select("src", "dst", F.round("similarity", 6).alias("similarity"), "rank")


@query("SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM embeddings WHERE embedding IS NOT NULL")
def equal_vector_classes(spark, sf_dir):
    """Who belongs to the classes that similar pairs name."""
    return equal_vectors(_vectors(spark, sf_dir))


def _item_queries(spark, sf_dir) -> DataFrame:
    """Benchmark items as whole queries; the vector of the same number stands for an item's embedding, items without one have none."""
    vectors = _vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding")
    return _batch(spark, sf_dir).join(vectors, "query_id", "left")


FUSE_CTE = f"""{ITEMS}, {BM25_CTE}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
kn AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank
       FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS sim FROM v q JOIN qs ON qs.query_id = q.vec_id, v)),
fz AS (SELECT query_id, id, sum(s) AS score FROM (SELECT query_id, id, .45 / (60 + rank) AS s FROM kn WHERE rank <= 60
       UNION ALL SELECT query_id, doc_id, .35 / (60 + rank) FROM bm WHERE rank <= 60) GROUP BY ALL)"""


def _fused(spark, sf_dir, pool: int = 60) -> DataFrame:
    asked = _item_queries(spark, sf_dir)
    words = kw.bm25(asked, _index(spark, sf_dir), pool)
    vectors = ve.knn(asked, _vectors(spark, sf_dir), pool)
    semantic, keyword, _ = fu.CHANNEL_WEIGHTS["mixed"]
    return fu.rrf([(vectors, F.lit(semantic)), (words, F.lit(keyword))])


@query(f"""WITH {FUSE_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fz)
SELECT query_id, id, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= 20""")
def rrf_fuse_two_channels(spark, sf_dir):
    """Vector and keyword channels fused by weighted reciprocal rank."""
    return fu.pool_cut(_fused(spark, sf_dir), 20).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


TITLE = "string_split(text, chr(10))[1]"


def _titles(spark, sf_dir) -> DataFrame:
    """Documents as notes: the first line stands as the title."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.element_at(F.split("text", "\n"), 1).alias("title"), "text")


@query(f"""WITH {ITEMS}, q AS (SELECT query_id, list_distinct({_tok('q')}) AS qt FROM qs), n AS (SELECT doc_id AS id, list_distinct({_tok(TITLE)}) AS tt FROM documents),
h AS (SELECT query_id, id, len(qt) AS nq, len(tt) AS nt, len(list_intersect(qt, tt)) AS overlap FROM q, n),
c AS (SELECT query_id, id, overlap, greatest(overlap / nq, overlap / nt) AS coverage FROM h WHERE overlap > 0)
SELECT query_id, id, overlap, round(coverage, 6) AS coverage, round(0.30 * (0.4 + 0.6 * coverage), 6) AS boost FROM c WHERE coverage >= 0.4""")
def title_keyword_boost(spark, sf_dir):
    """R6."""
    out = fu.title_boost(_batch(spark, sf_dir), _titles(spark, sf_dir))
    return out.select("query_id", "id", "overlap", F.round("coverage", 6).alias("coverage"), F.round("boost", 6).alias("boost"))


BARE = "regexp_replace({0}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
SALIENT_CTE = f"""
ra AS (SELECT query_id, q, list_filter(string_split_regex(q, '\\s+'), lambda t: {BARE.format('t')} <> '' OR regexp_matches(t, '[.?!]$')) AS raw FROM qs),
sl AS (SELECT query_id, list_sort(list_distinct(list_filter(list_transform(raw, lambda t, i: CASE WHEN regexp_matches({BARE.format('t')}, '^\\p{{L}}*\\p{{Ll}}\\p{{Lu}}\\p{{L}}*$')
         OR (regexp_matches({BARE.format('t')}, '^\\p{{Lu}}\\p{{Ll}}{{2,}}$') AND i > 1 AND NOT regexp_matches(raw[i - 1], '[.?!]$')) THEN lower({BARE.format('t')}) END),
         lambda w: w IS NOT NULL AND length(w) >= 3 AND NOT list_contains([{_STOP}], w)))) AS names,
       list_sort(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(q, '"([^"]{{2,60}})"', 1), lambda p: lower(trim(p))), lambda p: p <> ''),
         list_filter(list_transform(regexp_extract_all(q, '\\x27([^\\x27]{{2,60}})\\x27', 1), lambda p: lower(trim(p))), lambda p: contains(p, ' '))))) AS phrases,
       list_sort(list_distinct(regexp_extract_all(q, '\\b\\d{{1,4}}\\b'))) AS numerals FROM ra)"""


def _hits_in(names: str, words: str) -> str:
    return f"(CASE WHEN len({names}) > 0 THEN 0.15 * len(list_intersect(list_distinct({words}), {names})) / len({names}) ELSE 0.0 END)"


def _exact_sql(pool: str) -> str:
    """R8 over a relation (query_id, id) of the pool and notes ``nt`` (id, title, content)."""
    return f"""hx AS (SELECT query_id, id, names, phrases, numerals, lower(concat_ws(chr(10), coalesce(title, ''), coalesce(content, ''))) AS hay FROM {pool} JOIN nt USING (id) JOIN sl USING (query_id)),
hw AS (SELECT *, string_split_regex(hay, '[^\\p{{L}}\\p{{N}}]+') AS words FROM hx),
eb AS (SELECT query_id, id, boost FROM (SELECT query_id, id, (CASE WHEN len(list_filter(phrases, lambda p: contains(hay, p))) > 0 THEN 0.20 ELSE 0.0 END) + {_hits_in('names', 'words')} + {_hits_in('numerals', 'words')} AS boost FROM hw) WHERE boost > 0)"""


#: Items with a phrase of theirs in quotes, a word with a capital and a numeral at their end.
NAMED = """qs AS (SELECT query_id, concat_ws(' ', q, '"' || w[2] || ' ' || w[3] || '"', 'of', upper(w[5][1:1]) || lower(w[5][2:]), '12') AS q
FROM (SELECT item_id AS query_id, text AS q, string_split(text, ' ') AS w FROM benchmark))"""


def _named_queries(spark, sf_dir) -> DataFrame:
    w = lambda i: F.element_at(F.split("q", " "), i)
    name = F.concat(F.upper(F.left(w(5), F.lit(1))), F.lower(F.substr(w(5), F.lit(2))))
    phrase = F.concat(F.lit('"'), w(2), F.lit(" "), w(3), F.lit('"'))
    return _batch(spark, sf_dir).select("query_id", F.concat_ws(" ", "q", phrase, F.lit("of"), name, F.lit("12")).alias("q"))


@query(f"WITH {NAMED}, {SALIENT_CTE} SELECT query_id, array_to_string(names, '|') AS names, array_to_string(phrases, '|') AS phrases, array_to_string(numerals, '|') AS numerals FROM sl")
def salient_terms(spark, sf_dir):
    """names, quoted phrases and numerals of each query."""
    found = _named_queries(spark, sf_dir).select("query_id", extract_salient(F.col("q")).alias("s"))
    return found.select("query_id", *[F.array_join(F.col("s")[c], "|").alias(c) for c in ("names", "phrases", "numerals")])


@query(f"""WITH {NAMED}, {BM25_CTE}, {SALIENT_CTE}, nt AS (SELECT doc_id AS id, {TITLE} AS title, text AS content FROM documents), pl AS (SELECT query_id, doc_id AS id FROM bm WHERE rank <= 50), {_exact_sql('pl')}
SELECT query_id, id, round(boost, 6) AS boost FROM eb""")
def exact_match_boost(spark, sf_dir):
    """Names, quoted phrases and numerals of each query, looked for in its pool."""
    asked = _named_queries(spark, sf_dir)
    pool = kw.bm25(asked, _index(spark, sf_dir), 50)
    return rc.exact_boost(asked, pool, _titles(spark, sf_dir).withColumnRenamed("text", "content")).select("query_id", "id", F.round("boost", 6).alias("boost"))


NOW = "2024-03-01 00:00:00"


@query(f"""WITH {FUSE_CTE}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fz),
c AS (SELECT query_id, id, TIMESTAMP '2024-01-01' + to_days((id % 60)::INT) AS u FROM r WHERE rank <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY u DESC, id) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS n FROM c)
SELECT query_id, id, round((CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 + place / (n - 1) * (0.6 - 1.0) END) * exp(-0.01 * greatest(epoch(TIMESTAMP '{NOW}' - u) / 86400.0, 0)), 6) AS recency_factor FROM o""")
def recency_factor(spark, sf_dir):
    """R14 with dates made from ids and a fixed now."""
    pool = fu.pool_cut(_fused(spark, sf_dir), 20).withColumn("updated_at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 60 as int))"))
    out = fu.recency_factor(pool, "fresh", F.lit(NOW).cast("timestamp"))
    return out.select("query_id", "id", F.round("recency_factor", 6).alias("recency_factor"))


@query(f"""WITH {KNN_CTE}, c AS (SELECT query_id, id, sim AS score, (id * 7919) % 101 AS ce, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS h FROM kq QUALIFY h <= 20),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce DESC, h) AS c FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(.7 / (60 + h) + 1.0 / (60 + c), 15) DESC, h) AS k FROM x)
SELECT f.query_id, f.id, round(m.score, 6) AS fused_score FROM f JOIN f m ON m.query_id = f.query_id AND m.h = f.k""")
def rank_fusion_permute(spark, sf_dir):
    """The same magnitudes in the fused order."""
    hits = ve.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), 20, skip_self=True)
    scored = hits.select("query_id", "id", F.col("similarity").alias("score"), ((F.col("id") * 7919) % 101).alias("ce"))
    return fu.rank_fuse(scored).select("query_id", "id", F.round("fused_score", 6).alias("fused_score"))


TT = f"list_distinct(list_filter(string_split_regex(lower({TITLE}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 3 AND NOT list_contains([{_TSTOP}], w)))"


@query(f"""WITH {FUSE_CTE}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fz),
c AS (SELECT query_id, id, TIMESTAMP '2024-01-01' + to_days((id % 60)::INT) AS u, {TT} AS t FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 20),
p AS (SELECT DISTINCT a.query_id, a.id FROM c a JOIN c b ON a.query_id = b.query_id AND a.id <> b.id
      WHERE date_diff('day', a.u, b.u) >= 1 AND len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.35)
SELECT c.query_id, c.id, CASE WHEN p.id IS NULL THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS penalty FROM c LEFT JOIN p ON p.query_id = c.query_id AND p.id = c.id""")
def temporal_disambiguation(spark, sf_dir):
    """R18."""
    pool = fu.pool_cut(_fused(spark, sf_dir), 20).join(_titles(spark, sf_dir).drop("text"), "id")
    dated = pool.withColumn("created_at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 60 as int))"))
    return fu.temporal_disambiguation(dated).select("query_id", "id", "penalty")


@query()
def mmr_rerank(spark, sf_dir):
    """Greedy diversity over each query's pool."""
    hits = ve.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), 30, skip_self=True)
    pool = hits.select("query_id", "id", F.col("similarity").alias("score")).join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding"), "id")
    return fu.mmr(pool)


@query(f"""WITH qs AS (SELECT item_id * 2 + x AS query_id, array_to_string(CASE WHEN x = 0 THEN w[: len(w) // 2] ELSE w[len(w) // 2 + 1 :] END, ' ') AS q FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), (SELECT unnest([0, 1]) AS x)), {BM25_CTE}
SELECT query_id // 2 AS query_id, doc_id AS id, round(sum(1 / (60 + rank)), 9) AS score FROM bm WHERE rank <= 20 GROUP BY ALL""")
def multi_query_rrf(spark, sf_dir):
    """Two phrasings per need, the halves of its text, fused by plain reciprocal rank."""
    words, half = F.split("text", " "), F.floor(F.size("w") / 2).cast("int")
    asked = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), F.explode(F.array(F.lit(0), F.lit(1))).alias("x"))
    asked = asked.select((F.col("item_id") * 2 + F.col("x")).alias("query_id"), F.array_join(F.when(F.col("x") == 0, F.slice("w", F.lit(1), half)).otherwise(F.slice("w", half + 1, F.size("w") - half)), " ").alias("q"))
    hits = kw.bm25(asked, _index(spark, sf_dir), 20).withColumn("query_id", F.floor(F.col("query_id") / 2))
    return fu.rrf([(hits, F.lit(1.0))]).select("query_id", "id", F.round("score", 9).alias("score"))


@query(f"""WITH {ITEMS}, {BM25_CTE}, h AS (SELECT query_id, doc_id AS id, score, source AS brain FROM bm JOIN documents USING (doc_id) WHERE rank <= 50),
s AS (SELECT *, count(*) OVER w AS n, stddev_samp(score) OVER w AS sd, avg(score) OVER w AS mu FROM h WINDOW w AS (PARTITION BY query_id, brain))
SELECT query_id, id, brain, round(CASE WHEN n < 2 OR sd < 1e-12 THEN 0.0 ELSE (score - mu) / sd END, 5) AS z FROM s""")
def cross_brain_zscore(spark, sf_dir):
    """Sources stand as brains."""
    hits = kw.bm25(_batch(spark, sf_dir), _index(spark, sf_dir), 50)
    brains = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("brain"))
    return fu.zscore_merge(hits.join(brains, "id")).select("query_id", "id", "brain", F.round("z", 5).alias("z"))


@query(f"""WITH {KNN_CTE}, best AS (SELECT query_id, id // 4 AS note_id, arg_max(id, (round(sim, 9), -id)) AS chunk_id, max(sim) AS s FROM kq GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, note_id) AS rank FROM best)
SELECT query_id, note_id, chunk_id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5""")
def chunk_recall_best_per_doc(spark, sf_dir):
    """Four vectors make a note; its best chunk stands for it."""
    n = 60  # over-fetch: the best note of a query has at most 4 chunks, so 60 chunks hold at least 15 notes
    hits = ve.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), n, skip_self=True).withColumn("note_id", F.floor(F.col("id") / 4))
    first = Window.partitionBy("query_id", "note_id").orderBy("rank")
    best = hits.withColumn("first", F.row_number().over(first)).where("first = 1")
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "note_id")
    out = best.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    return out.select("query_id", "note_id", F.col("id").alias("chunk_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query("""WITH q AS (SELECT item_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM benchmark),
k AS (SELECT *, len(list_intersect(list_transform(w[1:3], lambda x: lower(x)), ['what', 'how', 'why', 'which', 'where', 'when', 'who', 'does', 'is', 'can'])) > 0 AS asks FROM q)
SELECT item_id, CASE WHEN len(w) <= 4 AND NOT asks THEN 'keyword' WHEN asks AND len(w) > 6 THEN 'natural' ELSE 'mixed' END AS shape FROM k""")
def query_shape(spark, sf_dir):
    """The shape picks the channel weights."""
    return table(spark, sf_dir, "benchmark").select("item_id", classify_query(F.col("text")).alias("shape"))


@query(r"""SELECT conv_id, turn, CASE WHEN f AND NOT h THEN 'fresh' WHEN h AND NOT f THEN 'historical' ELSE 'neutral' END AS intent FROM (SELECT conv_id, turn,
regexp_matches(text, '(?i)\b(recent|recently|latest|newest|current|currently|now|today|tonight|yesterday|just now|lately|updated|newly|most recent|this (week|month|year|morning|afternoon|evening)|in the last \w+|for the last \w+)\b') AS f,
regexp_matches(text, '(?i)\b(original|originally|first|initially|initial|used to|back then|back when|previously|formerly|historically|ancient|long ago|in the past|at the start|at the beginning|early on|earlier|old(est|er)?|was (the|a|an|my|our|your)|were (the|a|my|our|your)|before (we|i|they|you))\b') AS h FROM conversations)""")
def temporal_intent_of_turns(spark, sf_dir):
    """F17."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", temporal_intent(F.col("text")).alias("intent"))


@query(f"""WITH {KNN_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM kq QUALIFY rank <= 10),
g AS (SELECT q.vec_id AS query_id, count(*) - 1 AS gold FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id),
m AS (SELECT query_id, sum((label = qlabel)::INT) AS hits, coalesce(max(CASE WHEN label = qlabel THEN 1 / rank END), 0) AS rr,
      sum(CASE WHEN label = qlabel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r GROUP BY query_id),
i AS (SELECT query_id, gold, (SELECT sum(1 / log2(x + 1)) FROM generate_series(1, least(gold, 10)) t(x)) AS idcg FROM g)
SELECT query_id, (hits > 0)::INT AS hit, round(hits / gold, 6) AS recall, round(hits / 10, 6) AS precision, round(rr, 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM m JOIN i USING (query_id) WHERE gold > 0""")
def ir_metrics(spark, sf_dir):
    """Labels are the gold; one row of metrics per query."""
    from memlake.operators.irmetrics import ranked_metrics

    hits = ve.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), 10, skip_self=True)
    labels = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    gold = _asked(spark, sf_dir).select("query_id", "label").join(labels, "label").where("id <> query_id").select("query_id", "id")
    return ranked_metrics(hits, gold, 10)


@query(f"""WITH {KNN_CTE}, t AS (SELECT query_id, max(sim) AS top, (query_id % 3 = 0) AS is_abs FROM kq GROUP BY query_id),
u AS (SELECT DISTINCT top FROM t), mid AS (SELECT (top + lead(top) OVER (ORDER BY top)) / 2 AS tau FROM u),
b AS (SELECT tau, (avg(CASE WHEN is_abs THEN (top < tau)::INT END) + avg(CASE WHEN NOT is_abs THEN (top >= tau)::INT END)) / 2 AS acc FROM mid, t WHERE tau IS NOT NULL GROUP BY tau)
SELECT round(tau, 6) AS tau, round(acc, 6) AS balanced_accuracy FROM b ORDER BY round(acc, 9) DESC, tau DESC LIMIT 1""")
def abstention_sweep(spark, sf_dir):
    """The threshold of best balanced accuracy, larger one on ties."""
    from memlake.operators.irmetrics import abstention_threshold

    tops = ve.knn(_asked(spark, sf_dir), _vectors(spark, sf_dir), 1, skip_self=True)
    return abstention_threshold(tops.select(F.col("similarity").alias("top"), (F.col("query_id") % 3 == 0).alias("is_abs")))


_SHAPE = """(SELECT query_id, CASE WHEN len(w) <= 4 AND NOT asks THEN 'keyword' WHEN asks AND len(w) > 6 THEN 'natural' ELSE 'mixed' END AS shape FROM (SELECT query_id, w,
len(list_intersect(list_transform(w[1:3], lambda x: lower(x)), ['what', 'how', 'why', 'which', 'where', 'when', 'who', 'does', 'is', 'can'])) > 0 AS asks FROM (SELECT query_id, list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '') AS w FROM qs)))"""
_W = "CASE shape WHEN 'keyword' THEN {0} WHEN 'natural' THEN {1} ELSE {2} END"


def _recall_notes(spark, sf_dir) -> DataFrame:
    """Documents as notes: toxic ones are dormant, good ones insights, dates and strengths follow the ids."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    made, i = _titles(spark, sf_dir).withColumnRenamed("text", "content").join(labels, "id", "left"), F.col("id")
    day = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 60 as int))")
    return made.select(
        "id", "title", "content", F.when(F.col("quality") == 1, "insight").otherwise("note").alias("kind"), F.when(F.col("toxic") == 1, "dormant").otherwise("active").alias("state"),
        F.lit(None).cast("long").alias("superseded_by"), ((i % 10) / 10).alias("strength"), day.alias("created_at"), day.alias("updated_at"), F.concat(F.lit("n/"), i.cast("string")).alias("filename"),
        F.lit(None).cast("string").alias("agent_id"), F.lit(0.9).alias("confidence"))


@query(f"""WITH {ITEMS}, {BM25_CTE}, {SALIENT_CTE},
lb AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
nt AS (SELECT d.doc_id AS id, {TITLE} AS title, text AS content, coalesce(quality = 1, false) AS insight, (d.doc_id % 10) / 10 AS strength, TIMESTAMP '2024-01-01' + to_days((d.doc_id % 60)::INT) AS u
       FROM documents d LEFT JOIN lb ON lb.doc_id = d.doc_id WHERE coalesce(toxic, 0) <> 1),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
aw AS (SELECT s.query_id, v.e AS e, {_W.format('.30', '.55', '.45')} AS ws, {_W.format('.50', '.25', '.35')} AS wk FROM {_SHAPE} s LEFT JOIN v ON v.vec_id = s.query_id),
kn AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM (SELECT query_id, v.vec_id AS id, list_cosine_similarity(aw.e, v.e) AS sim FROM aw, v JOIN nt ON nt.id = v.vec_id WHERE aw.e IS NOT NULL)),
fz AS (SELECT query_id, id, sum(s) AS score FROM (SELECT query_id, id, ws / (60 + rank) AS s FROM kn JOIN aw USING (query_id) WHERE rank <= 60
       UNION ALL SELECT query_id, doc_id, wk * (CASE WHEN e IS NULL THEN 1.0 / (1.0 - ws) ELSE 1.0 END) / (60 + rank) FROM bm JOIN aw USING (query_id) WHERE rank <= 60) GROUP BY ALL),
tq AS (SELECT query_id, list_distinct({_tok('q')}) AS qt FROM qs), tn AS (SELECT id, list_distinct({_tok('title')}) AS tt FROM nt),
tb AS (SELECT query_id, id, 0.30 * (0.4 + 0.6 * c) AS boost FROM (SELECT query_id, id, greatest(o / len(qt), o / len(tt)) AS c FROM (SELECT *, len(list_intersect(qt, tt)) AS o FROM tq, tn) WHERE o > 0) WHERE c >= 0.4),
s1 AS (SELECT coalesce(f.query_id, t.query_id) AS query_id, coalesce(f.id, t.id) AS id, coalesce(f.score, 0) + coalesce(t.boost, 0) AS score FROM fz f FULL JOIN tb t ON f.query_id = t.query_id AND f.id = t.id),
{_exact_sql('s1')},
pl AS (SELECT query_id, id, score FROM (SELECT s1.query_id, s1.id, score + coalesce(boost, 0) AS score FROM s1 LEFT JOIN eb ON eb.query_id = s1.query_id AND eb.id = s1.id)
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 60),
it AS (SELECT query_id, CASE WHEN f AND NOT h THEN 'fresh' WHEN h AND NOT f THEN 'historical' ELSE 'neutral' END AS intent FROM (SELECT query_id, regexp_matches(q, '{FRESH}') AS f, regexp_matches(q, '{HISTORICAL}') AS h FROM qs)),
hd AS (SELECT pl.query_id, pl.id, score, intent, nt.* EXCLUDE (id), row_number() OVER (PARTITION BY pl.query_id ORDER BY u DESC, pl.id) - 1 AS place, count(*) OVER (PARTITION BY pl.query_id) AS n FROM pl JOIN nt ON nt.id = pl.id JOIN it ON it.query_id = pl.query_id),
rf AS (SELECT *, (CASE intent WHEN 'fresh' THEN CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 + place / (n - 1) * (0.6 - 1.0) END WHEN 'historical' THEN CASE WHEN n <= 1 THEN 0.6 ELSE 0.6 + place / (n - 1) * (1.0 - 0.6) END ELSE 1.0 END)
       * exp(-(CASE intent WHEN 'fresh' THEN .01 WHEN 'neutral' THEN .001 ELSE 0 END) * greatest(epoch(TIMESTAMP '{NOW}' - u) / 86400.0, 0)) AS r FROM hd),
fs AS (SELECT *, round((0.75 * score + 0.15 * strength) * r + CASE WHEN insight THEN 0.06 ELSE 0.0 END, 4) AS s2, {TT.replace(TITLE, 'title')} AS t FROM rf),
tp AS (SELECT DISTINCT a.query_id, a.id FROM fs a JOIN fs b ON a.query_id = b.query_id AND a.id <> b.id
       WHERE date_diff('day', a.u, b.u) >= 1 AND len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.35),
fn AS (SELECT fs.query_id, fs.id, round(s2 - CASE WHEN tp.id IS NULL THEN 0.0 ELSE 0.05 END, 4) AS score, length(content[1:1200]) AS shown_chars FROM fs LEFT JOIN tp ON tp.query_id = fs.query_id AND tp.id = fs.id)
SELECT query_id, id, score, shown_chars, e IS NULL AS degraded, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS place FROM fn JOIN aw USING (query_id) QUALIFY place <= 10""")
def hybrid_recall_core(spark, sf_dir):
    """The composed recall with the parts that the tables hold."""
    chunks = _vectors(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("string").alias("text"))
    hits = rc.recall(_item_queries(spark, sf_dir), _recall_notes(spark, sf_dir), _index(spark, sf_dir), F.lit(NOW).cast("timestamp"), chunks=chunks)
    return hits.select("query_id", "id", "score", F.length("shown").cast("long").alias("shown_chars"), "degraded", "place")
