"""Injection gate and composition (M1, M4, M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gate(candidates: DataFrame, base: float = 0.60, vague_boost: float = 0.15, strict: bool = False, min_gap: float = 0.04, max_memories: int = 3) -> DataFrame:
    """M1: which of (query_id, id, ce, strong, vague) may be shown, with the floor that held.

    The best candidate must reach the floor and, unless it is strong or very
    sure, lead the next by the gap.  Others follow within 0.10 below the floor.
    """
    w = Window.partitionBy("query_id")
    r = candidates.withColumn("rank", F.row_number().over(w.orderBy(F.round("ce", 9).desc(), "id")))
    first = F.col("rank") == 1
    r = r.withColumns({"top": F.max(F.when(first, F.col("ce"))).over(w), "second": F.max(F.when(F.col("rank") == 2, F.col("ce"))).over(w), "tops": F.max(F.when(first, F.col("strong"))).over(w)})
    floor = F.lit(base) + F.when(F.col("vague"), vague_boost).otherwise(0.0) + (0.10 if strict else 0.0) - F.when(F.col("tops"), 0.10).otherwise(0.0)
    r = r.withColumn("floor", F.greatest(floor, F.lit(0.35)))
    clear = F.col("tops") | (F.col("top") >= 0.80) | F.col("second").isNull() | (F.col("top") - F.col("second") >= min_gap)
    kept = r.where((F.col("top") >= F.col("floor")) & clear & (F.col("ce") >= F.col("floor") - 0.10))
    return kept.withColumn("k", F.row_number().over(w.orderBy("rank"))).where(F.col("k") <= max_memories).drop("k", "top", "second", "tops")


def compose(sections: DataFrame, budget: int) -> DataFrame:
    """M4: keep (query_id, section, tokens) from the first section on while the running sum fits."""
    w = Window.partitionBy("query_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def merge_state(updates: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """M7: the newest non-null value of each field."""
    return updates.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields])
