"""Rank fusion and re-scoring of retrieved candidates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import jaccard, title_tokens, tokenize

#: Channel weights (semantic, keyword, graph) by query shape.
CHANNEL_WEIGHTS = {"keyword": (0.30, 0.50, 0.20), "natural": (0.55, 0.25, 0.20), "mixed": (0.45, 0.35, 0.20)}
#: Newest factor, oldest factor, decay per day by temporal intent.
RECENCY = {"fresh": (1.00, 0.60, 0.01), "historical": (0.60, 1.00, 0.0), "neutral": (1.00, 1.00, 0.001)}


def rrf(channels: list[tuple[DataFrame, Column]], constant: int = 60) -> DataFrame:
    """``(query_id, id, score)`` summing weight / (constant + rank) over ranked channels."""
    parts = [c.select("query_id", "id", (w / (constant + F.col("rank"))).alias("s")) for c, w in channels]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def pool_cut(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each query, id settles ties."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def title_boost(queries: DataFrame, notes: DataFrame, least: float = 0.4) -> DataFrame:
    """``(query_id, id, boost)`` by overlap of query tokens with title tokens, found through an equi-join on tokens."""
    q = queries.select("query_id", F.array_distinct(tokenize(F.col("q"))).alias("qt"))
    t = notes.select("id", F.array_distinct(tokenize(F.col("title"))).alias("tt"))
    hits = (
        q.select("query_id", F.size("qt").alias("nq"), F.explode("qt").alias("token"))
        .join(t.select("id", F.size("tt").alias("nt"), F.explode("tt").alias("token")), "token")
        .groupBy("query_id", "id", "nq", "nt").agg(F.count(F.lit(1)).alias("overlap")))
    coverage = F.greatest(F.col("overlap") / F.col("nq"), F.col("overlap") / F.col("nt"))
    return hits.withColumn("coverage", coverage).where(F.col("coverage") >= least).select("query_id", "id", "overlap", "coverage", (0.30 * (0.4 + 0.6 * F.col("coverage"))).alias("boost"))


def recency_factor(candidates: DataFrame, intent: str | Column, now: Column, updated: str = "updated_at") -> DataFrame:
    """Adds ``recency_factor``: linear in the rank by time, times a decay per day of age; ``intent`` is a word or a column."""
    if isinstance(intent, str):
        newest, oldest, decay = RECENCY[intent]
    else:
        newest, oldest, decay = (F.coalesce(*[F.when(intent == name, v[i]) for name, v in RECENCY.items()]) for i in range(3))
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy(F.col(updated).desc(), "id")) - 1
    n = F.count(F.lit(1)).over(w)
    linear = F.when(n <= 1, newest).otherwise(newest + place / (n - 1) * (oldest - newest))
    days = F.greatest((F.unix_timestamp(now) - F.unix_timestamp(F.col(updated))) / 86400.0, F.lit(0.0))
    return candidates.withColumn("recency_factor", linear * F.exp(-decay * days))


def rank_fuse(candidates: DataFrame, hybrid: str = "score", other: str = "ce", w_hybrid: float = 0.7, w_other: float = 1.0) -> DataFrame:
    """Fuses two orders by reciprocal rank and deals the same magnitudes out in the fused order, as ``fused_score``."""
    w = Window.partitionBy("query_id")
    ranked = candidates.withColumn("__h", F.row_number().over(w.orderBy(F.col(hybrid).desc(), "id"))).withColumn("__c", F.row_number().over(w.orderBy(F.col(other).desc(), "__h")))
    ranked = ranked.withColumn("__f", w_hybrid / (60 + F.col("__h")) + w_other / (60 + F.col("__c")))
    ranked = ranked.withColumn("__k", F.row_number().over(w.orderBy(F.round("__f", 15).desc(), "__h")))
    magnitudes = ranked.select("query_id", F.col("__h").alias("__k"), F.col(hybrid).alias("fused_score"))
    return ranked.join(magnitudes, ["query_id", "__k"]).drop("__h", "__c", "__f", "__k")


def temporal_disambiguation(candidates: DataFrame, penalty: float = 0.05, least: float = 0.35) -> DataFrame:
    """Adds ``penalty`` where another candidate of the query has a like title and is a day newer or more."""
    c = candidates.withColumn("__t", title_tokens(F.col("title")))
    o = c.select(F.col("query_id").alias("q2"), F.col("id").alias("id2"), F.col("created_at").alias("c2"), F.col("__t").alias("t2"))
    newer = (
        c.join(o, (F.col("query_id") == F.col("q2")) & (F.col("id") != F.col("id2")))
        .where((F.datediff("c2", "created_at") >= 1) & (jaccard(F.col("__t"), F.col("t2")) >= least))
        .select("query_id", "id").distinct().withColumn("penalty", F.lit(penalty)))
    return c.drop("__t").join(newer, ["query_id", "id"], "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))


def final_score(score: Column, strength: Column, recency: Column, insight: Column) -> Column:
    """R17."""
    return F.round((0.75 * score + 0.15 * strength) * recency + F.when(insight, 0.06).otherwise(0.0), 4)


def mmr(candidates: DataFrame, lam: float = 0.7, k: int = 10) -> DataFrame:
    """``(query_id, id, mmr_rank)``; greedy and sequential, so one small pandas group per query (its pool)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        m = np.array([np.asarray(v, float) for v in pdf["embedding"]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        sims, score = m @ m.T, pdf["score"].to_numpy()
        chosen, left = [0], list(range(1, len(pdf)))
        while left and len(chosen) < k:
            gain = [lam * score[i] - (1 - lam) * sims[i, chosen].max() for i in left]
            chosen.append(left.pop(max(range(len(left)), key=lambda x: (round(gain[x], 12), -left[x]))))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[chosen], "id": pdf["id"].iloc[chosen], "mmr_rank": range(1, len(chosen) + 1)})

    return candidates.select("query_id", "id", "score", "embedding").groupBy("query_id").applyInPandas(pick, "query_id long, id long, mmr_rank int")


def zscore_merge(hits: DataFrame, brain: str = "brain") -> DataFrame:
    """Adds ``z`` per brain (sample deviation); fewer than two hits or no spread give 0."""
    w = Window.partitionBy("query_id", brain)
    n, sd = F.count(F.lit(1)).over(w), F.stddev_samp("score").over(w)
    return hits.withColumn("z", F.when((n < 2) | (sd.isNull()) | (sd < 1e-12), 0.0).otherwise((F.col("score") - F.avg("score").over(w)) / sd))
