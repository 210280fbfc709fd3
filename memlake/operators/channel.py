"""Entity-graph channel and the assembly of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.signals import explain_hit


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("word")).distinct()


def query_entities(queries: DataFrame, entities: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Distinct (query_id, entity_id) where a word of the query is one of the name, or ``named`` (query_id, name) gives the name.

    ``queries`` has (query_id, q), ``entities`` (entity_id, name).  Null texts
    match nothing.
    """
    out = _words(queries, "query_id", "q").join(_words(entities, "entity_id", "name"), "word").select("query_id", "entity_id")
    if named is not None:
        exact = named.select("query_id", F.lower("name").alias("__n")).join(entities.select("entity_id", F.lower("name").alias("__n")), "__n")
        out = out.unionByName(exact.select("query_id", "entity_id"))
    return out.distinct()


def graph_channel(asked: DataFrame, mentions: DataFrame, links: DataFrame, live: DataFrame, limit: int, per_node: int = 5, least: float = 0.5) -> DataFrame:
    """(query_id, id, hop, rank): notes that mention the asked entities, then their best neighbours, ``limit`` a query.

    ``asked`` has (query_id, entity_id), ``mentions`` (entity_id, id), ``links``
    (src, dst, similarity), ``live`` the ids of visible notes.  A node has its
    ``per_node`` best links above ``least``; that choice is made once per node,
    not once per query.  Both hops come by id, and the limit is the feature.
    """
    seen = live.select("id").distinct()
    one = asked.join(mentions.select("entity_id", "id").distinct(), "entity_id").select("query_id", "id").distinct().join(seen, "id", "left_semi")
    near = links.where(F.col("similarity") > least).join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    best = near.withColumn("__r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst"))).where(F.col("__r") <= per_node)
    two = one.join(best.select(F.col("src").alias("id"), "dst"), "id").select("query_id", F.col("dst").alias("id"))
    both = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2))).groupBy("query_id", "id").agg(F.min("hop").alias("hop"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "id"))).where(F.col("rank") <= limit)


def assemble_hits(scored: DataFrame, channels: DataFrame, notes: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The ``k`` best of (query_id, id, score, ce_prob, via_spread) with their notes' columns and reasons.

    ``by`` names a column that orders them instead of the score.
    ``channels`` has (query_id, id, channel, rank, sim), channel being semantic,
    keyword or graph, one row each.  Of notes, the columns confidence, filename
    and agent_id are carried; an empty agent becomes null.
    """
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*([by] if by else []), F.col("score").desc(), "id"))).where(F.col("place") <= k)
    of = lambda c, v: F.max(F.when(F.col("channel") == c, F.col(v)))
    ranks = channels.groupBy("query_id", "id").agg(of("semantic", "rank").alias("__s"), of("semantic", "sim").alias("__m"), of("keyword", "rank").alias("__k"), of("graph", "rank").alias("__g"))
    out = top.join(ranks, ["query_id", "id"], "left").join(notes.select("id", "confidence", "filename", "agent_id"), "id", "left")
    why = explain_hit(F.col("__s"), F.col("__m"), F.col("__k"), F.col("__g"), F.col("ce_prob"), F.col("via_spread"))
    return out.select("query_id", "place", "id", "score", "confidence", F.coalesce("filename", F.lit("")).alias("source"), F.nullif("agent_id", F.lit("")).alias("agent_id"), why.alias("why"))


def bump_access(notes: DataFrame, hits: DataFrame) -> DataFrame:
    """``access_count`` of notes plus the number of hits that showed them; null counts as 0."""
    shown = hits.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    return notes.join(shown, "id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).select(*notes.columns)
