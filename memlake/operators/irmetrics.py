"""Retrieval-quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """hit, recall, precision, mrr and ndcg at ``k`` for each query of ``gold`` (query_id, id)."""
    good = gold.distinct()
    found = hits.where(F.col("rank") <= k).join(good, ["query_id", "id"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    sizes = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    n = F.coalesce(F.col("hits"), F.lit(0))
    return sizes.join(found, "query_id", "left").select(
        "query_id", (n > 0).cast("int").alias("hit"), F.round(n / F.col("gold"), 6).alias("recall"), F.round(n / k, 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"))


def abstention_threshold(tops: DataFrame) -> DataFrame:
    """The midpoint of neighbouring top scores with the best balanced accuracy; the larger one on ties.

    Running counts over the sorted scores give every threshold's accuracy in one
    pass, so scores meet no cross join.  Scores of one query batch are few: they
    are first summed up by value.
    """
    values = tops.groupBy("top").agg(F.sum(F.col("is_abs").cast("int")).alias("a"), F.sum((~F.col("is_abs")).cast("int")).alias("b"))
    order = Window.orderBy("top")
    every = Window.orderBy("top").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swept = (
        values.withColumn("tau", (F.col("top") + F.lead("top").over(order)) / 2)
        .withColumn("acc", (F.sum("a").over(order) / F.sum("a").over(every) + 1 - F.sum("b").over(order) / F.sum("b").over(every)) / 2)
        .where("tau IS NOT NULL"))
    best = swept.agg(F.max(F.struct(F.round("acc", 9).alias("r"), "tau", "acc")).alias("m"))
    return best.select(F.round("m.tau", 6).alias("tau"), F.round("m.acc", 6).alias("balanced_accuracy"))
