"""The composed recall: channels, fusion, boosts, filters and re-scoring in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import classify_query, extract_salient, temporal_intent
from memlake.operators import fusion as fu
from memlake.operators import graph as gr
from memlake.operators import notes as no
from memlake.operators import orchestrate as oc
from memlake.operators.bm25 import KeywordIndex, bm25
from memlake.operators.channel import assemble_hits, graph_channel, query_entities
from memlake.operators.history import supersede_fraction
from memlake.operators.vector import knn
from memlake.plans.shared import SharedStage

#: A text's vector, and how well a note's text answers a query (a logit), as expressions.
Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]

#: The stages that ``off`` can switch off.
SWITCHES = ("semantic", "keyword", "graph", "title", "semantic_title", "exact", "facts", "pagerank", "chunk_window", "recency", "supersede", "rerank", "insight", "temporal", "mmr")


def channel_weights(queries: DataFrame, off: frozenset[str] = frozenset()) -> DataFrame:
    """Adds ``w_semantic``, ``w_keyword``, ``w_graph`` and ``degraded``.

    The query's shape gives the weights.  A query without a vector is degraded:
    the other channels share the weight of the semantic one.  A channel that is
    switched off has weight 0, and nobody shares that.
    """
    shape, down = classify_query(F.col("q")), F.col("embedding").isNull()
    pick = lambda i: F.coalesce(*[F.when(shape == s, w[i]) for s, w in fu.CHANNEL_WEIGHTS.items()])
    share = F.when(down & F.lit("semantic" not in off), 1.0 / (1.0 - pick(0))).otherwise(1.0)
    weight = {"w_semantic": F.when(down, 0.0).otherwise(pick(0)), "w_keyword": pick(1) * share, "w_graph": pick(2) * share}
    return queries.withColumns({**{c: F.lit(0.0) if c[2:] in off else w for c, w in weight.items()}, "degraded": down & F.lit("semantic" not in off)})


def semantic_channel(queries: DataFrame, chunks: DataFrame, pool: int, oversample: int = 8) -> DataFrame:
    """``(query_id, id, similarity, chunk_id, rank)``: each note by its best chunk; ``chunks`` has chunk_id, id and embedding."""
    found = knn(queries, chunks, min(4096, pool * oversample), id_col="chunk_id").withColumnRenamed("id", "chunk_id").drop("rank")
    owned = found.join(chunks.select("chunk_id", "id"), "chunk_id")
    best = owned.groupBy("query_id", "id").agg(F.max(F.struct(F.round("similarity", 9).alias("s"), (-F.col("chunk_id")).alias("c"), "similarity")).alias("m"))
    order = Window.partitionBy("query_id").orderBy(F.col("m.s").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).select("query_id", "id", F.col("m.similarity").alias("similarity"), (-F.col("m.c")).alias("chunk_id"), "rank")


def exact_boost(queries: DataFrame, pool: DataFrame, notes: DataFrame) -> DataFrame:
    """``(query_id, id, boost)`` for notes of the pool that hold a quoted phrase, names or numerals of the query."""
    asked = queries.select("query_id", extract_salient(F.col("q")).alias("s")).where("size(s.names) + size(s.phrases) + size(s.numerals) > 0")
    hay = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    seen = pool.select("query_id", "id").join(asked, "query_id").join(notes.select("id", hay.alias("hay")), "id")
    words = F.split("hay", r"[^\p{L}\p{N}]+")
    share = lambda c: F.when(F.size(c) > 0, 0.15 * F.size(F.array_intersect(words, F.col(c))) / F.size(c)).otherwise(0.0)
    phrase = F.when(F.exists("s.phrases", lambda p: F.contains("hay", p)), 0.20).otherwise(0.0)
    return seen.select("query_id", "id", (phrase + share("s.names") + share("s.numerals")).alias("boost")).where("boost > 0")


def add_boost(scores: DataFrame, boost: DataFrame, new: bool = False) -> DataFrame:
    """Scores plus boosts; with ``new``, a boost may bring a note in."""
    joined = scores.join(boost.select("query_id", "id", "boost"), ["query_id", "id"], "full_outer" if new else "left")
    return joined.select("query_id", "id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"))


def shown_text(content: Column, chunk: Column) -> Column:
    """The first 1200 characters, and the matched chunk after them unless its opening is among them; 3200 at most."""
    head, part = F.left(content, F.lit(1200)), F.trim(chunk)
    there = part.isNull() | (part == "") | F.contains(head, F.left(part, F.lit(40)))
    return F.when(there, head).otherwise(F.left(F.concat(head, F.lit("\n…\n"), part), F.lit(3200)))


def recall(
    queries: DataFrame, notes: DataFrame, index: KeywordIndex, now: Column, chunks: DataFrame | None = None, entities: DataFrame | None = None, mentions: DataFrame | None = None,
    links: DataFrame | None = None, facts: DataFrame | None = None, titles: DataFrame | None = None, ranks: DataFrame | None = None, logits: DataFrame | None = None,
    k: int = 10, pool: int = 60, off: frozenset[str] = frozenset(), operators: dict[str, str] | None = None, as_of: Column | None = None, spread: bool = False, rerank_top: int = 20,
    embedder: Embedder | None = None, reranker: Reranker | None = None,
) -> DataFrame:
    """The ``k`` best notes of each query: ``(query_id, place, id, score, confidence, source, agent_id, why, shown, degraded)``.

    ``queries`` has query_id, q and embedding (null: that query is degraded, and
    says so).  ``notes`` has id, title, content, kind, state, superseded_by,
    strength, created_at, updated_at, filename, agent_id and confidence.  A part
    of the data that is not given leaves its stage out: ``chunks`` (chunk_id,
    id, embedding, text), ``entities`` (entity_id, name) with ``mentions``
    (entity_id, id, name) and ``links`` (src, dst, similarity), ``facts``
    (subject, attribute, value, id, current), ``titles`` (id, embedding),
    ``ranks`` (id, pagerank) and ``logits`` (query_id, id, logit of a
    re-ranker).  An ``embedder`` makes the vectors that are not given: those of
    queries without one, of chunks (from their text) and of titles; a
    ``reranker`` judges the ``rerank_top`` best of each query in place of
    ``logits``.  Both are expressions, such as pandas UDFs, so the models run in
    Spark's tasks.  ``off`` names stages to switch off (``SWITCHES``), ``spread``
    adds notes linked to the best hits.

    Pools hold ``pool`` notes a query: that limit is the feature, and all later
    stages work on pools.
    """
    if unknown := off - set(SWITCHES):
        raise ValueError(f"no such stage: {sorted(unknown)}")
    on = lambda name, *needs: name not in off and all(x is not None for x in needs)
    stage = SharedStage(queries.sparkSession, "recall")
    if embedder is not None:
        have = F.col("embedding") if "embedding" in queries.columns else F.lit(None).cast("array<double>")
        queries = stage.put(queries.withColumn("embedding", F.coalesce(have, embedder(F.col("q")))), "queries")
        if chunks is not None and "embedding" not in chunks.columns:
            chunks = stage.put(chunks.withColumn("embedding", embedder(F.col("text"))), "chunks")
        if titles is None:
            titles = stage.put(notes.select("id", embedder(F.coalesce("title", F.lit(""))).alias("embedding")), "titles")
    if chunks is None:
        queries = queries.withColumn("embedding", F.lit(None).cast("array<double>"))
    asked = channel_weights(queries, off)
    weight = asked.select("query_id", "w_semantic", "w_keyword", "w_graph")
    live = no.visible(notes)
    # Channels (R1-R3), each (query_id, id, rank).
    channels = []
    if on("semantic", chunks):
        near = semantic_channel(asked.where("embedding IS NOT NULL"), chunks.join(live.select("id"), "id", "left_semi"), pool)
        channels.append(near.select("query_id", "id", F.lit("semantic").alias("channel"), "rank", F.col("similarity").alias("sim"), "chunk_id"))
    if on("keyword"):
        found = bm25(asked, index, pool)
        channels.append(found.select("query_id", "id", F.lit("keyword").alias("channel"), "rank", F.lit(None).cast("double").alias("sim"), F.lit(None).cast("long").alias("chunk_id")))
    if on("graph", entities, mentions, links):
        reached = graph_channel(query_entities(asked, entities), mentions, links, live, pool)
        channels.append(reached.select("query_id", "id", F.lit("graph").alias("channel"), "rank", F.lit(None).cast("double").alias("sim"), F.lit(None).cast("long").alias("chunk_id")))
    if not channels:
        raise ValueError("all channels are switched off")
    # Pools are small tables; writing them keeps each step from planning all those before it again.
    ranked = channels[0]
    for c in channels[1:]:
        ranked = ranked.unionByName(c)
    ranked = stage.put(ranked, "ranked")
    # Fusion (R5) and boosts.
    own = F.when(F.col("channel") == "semantic", F.col("w_semantic")).when(F.col("channel") == "keyword", F.col("w_keyword")).otherwise(F.col("w_graph"))
    scores = ranked.join(weight, "query_id").groupBy("query_id", "id").agg(F.sum(own / (60 + F.col("rank"))).alias("score"))
    if on("title"):
        scores = add_boost(scores, fu.title_boost(asked, live), new=True)
    scores = stage.put(scores, "scores")
    if on("semantic_title", titles):
        both = scores.join(titles.select("id", F.col("embedding").alias("t")), "id").join(asked.select("query_id", F.col("embedding").alias("e")).where("e IS NOT NULL"), "query_id")
        scores = add_boost(scores, oc.title_boost(both.select("query_id", "id", cosine(F.col("t"), F.col("e")).alias("similarity"))))
    if on("exact"):
        scores = add_boost(scores, exact_boost(asked, scores, live))
    if on("facts", facts):
        scores = oc.apply_facts(scores, oc.fact_adjustment(asked, facts))
    if on("pagerank", ranks):
        scores = oc.apply_rank(scores, ranks)
    # Pool (R11), notes and filters (R12), neighbours.
    kept = stage.put(fu.pool_cut(scores, pool).drop("rank"), "pool")
    held = kept.join(no.apply_filters(live, operators or {}, mentions, as_of), "id").withColumn("via_spread", F.lit(False))
    if spread and links is not None:
        best = held.select("query_id", "id", "score").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")))
        more = gr.spread(best, links).join(no.apply_filters(live, operators or {}, mentions, as_of), "id").withColumn("via_spread", F.lit(True))
        held = held.unionByName(more)
    # Time (R14, R15).
    held = held.join(asked.select("query_id", temporal_intent(F.col("q")).alias("intent"), "degraded"), "query_id")
    held = fu.recency_factor(held, F.col("intent"), now) if on("recency") else held.withColumn("recency_factor", F.lit(1.0))
    if on("supersede", facts):
        held = held.join(supersede_fraction(facts, "id", ~F.col("current")), "id", "left")
        lower, higher = F.col("recency_factor") * (1 - 0.5 * F.coalesce("fraction", F.lit(0.0))), F.least(F.lit(1.0), F.col("recency_factor") * 1.5)
        held = held.withColumn("recency_factor", F.when((F.col("intent") == "historical") & F.lit("recency" not in off), F.when(F.col("fraction").isNotNull(), higher).otherwise(F.col("recency_factor"))).otherwise(lower)).drop("fraction")
    held = stage.put(held, "held")
    # Re-ranking of the best (R16), then the score (R17) and like titles.
    held = held.withColumn("ce_prob", F.lit(None).cast("double"))
    if on("rerank") and (logits is not None or reranker is not None):
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
        judged = held.drop("ce_prob").withColumn("h", place)
        if logits is None:
            best = judged.where(F.col("h") <= rerank_top).select("query_id", "id", "content").join(asked.select("query_id", "q"), "query_id")
            logits = stage.put(best.select("query_id", "id", reranker(F.col("q"), F.coalesce("content", F.lit(""))).alias("logit")), "logits")
        judged = judged.join(logits.select("query_id", "id", "logit"), ["query_id", "id"], "left")
        top = fu.rank_fuse(judged.where(F.col("h") <= rerank_top).withColumn("logit", F.coalesce("logit", F.lit(-1e9))), "score", "logit").withColumn("score", F.col("fused_score")).drop("fused_score")
        prob = F.when(F.col("logit") > -1e9, 1.0 / (1.0 + F.exp(-F.col("logit"))))
        held = top.unionByName(judged.where(F.col("h") > rerank_top).withColumn("logit", F.lit(-1e9))).withColumn("ce_prob", prob).drop("h", "logit")
    insight = F.coalesce(F.col("kind") == "insight", F.lit(False)) if on("insight") else F.lit(False)
    held = held.withColumn("score", fu.final_score(F.col("score"), F.coalesce("strength", F.lit(1.0)), F.col("recency_factor"), insight))
    if on("temporal"):
        held = fu.temporal_disambiguation(held).withColumn("score", F.round(F.col("score") - F.col("penalty"), 4)).drop("penalty")
    # Diversity (R19) and hits.
    picked = held.select("query_id", "id", "score", "ce_prob", "via_spread")
    if on("mmr", titles):
        held = stage.put(held, "scored")
        picked = held.select("query_id", "id", "score", "ce_prob", "via_spread")
        order = fu.mmr(picked.join(titles.select("id", "embedding"), "id"), k=k)
        picked = picked.join(order, ["query_id", "id"]).withColumn("by", F.col("mmr_rank")).drop("mmr_rank")
    hits = assemble_hits(picked, ranked, notes, k, by="by" if "by" in picked.columns else None)
    chunk = ranked.where("channel = 'semantic'").select("query_id", "id", "chunk_id") if on("chunk_window", chunks) and "semantic" not in off else None
    texts = held.select("query_id", "id", "content", "degraded")
    if chunk is not None:
        texts = texts.join(chunk.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "id", F.col("text").alias("__chunk")), ["query_id", "id"], "left")
    else:
        texts = texts.withColumn("__chunk", F.lit(None).cast("string"))
    return hits.join(texts.select("query_id", "id", "degraded", shown_text(F.col("content"), F.col("__chunk")).alias("shown")), ["query_id", "id"])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)

