"""Offline scoring of proposals against gold items, with bootstrap intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.plans.shared import SharedStage


def states_gold(statement: Column, gold: Column, terms: Column) -> Column:
    """Whether a statement holds all terms, or the whole gold statement where there are none; letter case and runs of white space do not count."""
    said = F.lower(F.regexp_replace(F.coalesce(statement, F.lit("")), r"\s+", " "))
    whole = F.lower(F.trim(F.coalesce(gold, F.lit(""))))
    has_terms = F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0
    return F.when(has_terms, F.forall(terms, lambda t: F.contains(said, F.lower(t)))).otherwise((whole != "") & F.contains(said, whole))


def assign(proposals: DataFrame, gold: DataFrame) -> DataFrame:
    """``(unit_id, proposal_no, gold_no)``: each proposal and each gold item is used once at most.

    ``proposals`` has unit_id, proposal_no and statement; ``gold`` unit_id,
    gold_no, statement and terms.  Matches with more terms come first, then the
    earlier proposal, then the earlier item.  Each round takes all matches that
    lead at both of their ends, which gives what taking them one by one gives.
    """
    stage = SharedStage(proposals.sparkSession, "assign")
    g = gold.select("unit_id", "gold_no", F.col("statement").alias("gold"), "terms")
    met = proposals.select("unit_id", "proposal_no", "statement").join(g, "unit_id").where(states_gold(F.col("statement"), F.col("gold"), F.col("terms")))
    weight = F.greatest(F.size(F.coalesce("terms", F.array().cast("array<string>"))), F.lit(1))
    met = met.where("proposal_no IS NOT NULL AND gold_no IS NOT NULL")
    left = stage.put(met.select("unit_id", "proposal_no", "gold_no", weight.alias("weight")), "left")
    taken = None
    while True:  # each round takes one match of each unit at least
        order = [F.col("weight").desc(), "proposal_no", "gold_no"]
        lead = lambda key: F.row_number().over(Window.partitionBy("unit_id", key).orderBy(*order)) == 1
        won = stage.put(left.withColumns({"p": lead("proposal_no"), "g": lead("gold_no")}).where("p AND g").select("unit_id", "proposal_no", "gold_no"), "won")
        taken = won if taken is None else taken.unionByName(won)
        rest = left.join(won.select("unit_id", "proposal_no"), ["unit_id", "proposal_no"], "left_anti").join(won.select("unit_id", "gold_no"), ["unit_id", "gold_no"], "left_anti")
        left = stage.put(rest.select("unit_id", "proposal_no", "gold_no", "weight"), "left")
        if left.isEmpty():
            return taken


def unit_scores(proposals: DataFrame, gold: DataFrame) -> DataFrame:
    """``(unit_id, proposals, gold, matched, duplicates)`` of every unit on either side; a duplicate states an item that another one got."""
    got = assign(proposals, gold)
    said = proposals.join(got.withColumn("hit", F.lit(1)), ["unit_id", "proposal_no"], "left")
    g = gold.select("unit_id", F.col("statement").alias("gold"), "terms")
    again = (proposals.join(got, ["unit_id", "proposal_no"], "left_anti").join(g, "unit_id").where(states_gold(F.col("statement"), F.col("gold"), F.col("terms")))
             .groupBy("unit_id").agg(F.count_distinct("proposal_no").alias("duplicates")))
    ours = said.groupBy("unit_id").agg(F.count(F.lit(1)).alias("proposals"), F.count("hit").alias("matched"))
    theirs = gold.groupBy("unit_id").agg(F.count(F.lit(1)).alias("gold"))
    out = ours.join(theirs, "unit_id", "full_outer").join(again, "unit_id", "left")
    return out.select("unit_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("proposals", "gold", "matched", "duplicates")])


def bootstrap_interval(units: DataFrame, num: str, den: str, resamples: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row ``(value, low, high)`` for sum(num) / sum(den), units being drawn anew; nulls if all denominators are 0.

    A unit enters a resample as often as a Poisson draw of mean one says, which
    hashing makes repeatable; so units need no exchange, and only partial sums
    of each resample travel.
    """
    cdf, p, reached = [], math.exp(-1.0), 0.0
    for k in range(12):
        reached += p
        cdf.append(reached)
        p /= k + 1
    u = F.pmod(F.xxhash64("unit_id", F.col("r"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times = sum((F.when(u >= c, 1).otherwise(0) for c in cdf), F.lit(0))
    drawn = units.select("unit_id", F.col(num).alias("a"), F.col(den).alias("b"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r")).withColumn("w", times)
    ratios = drawn.groupBy("r").agg((F.sum(F.col("w") * F.col("a")) / F.nullif(F.sum(F.col("w") * F.col("b")), F.lit(0))).alias("x"))
    ends = ratios.agg(F.percentile("x", F.lit(alpha / 2)).alias("low"), F.percentile("x", F.lit(1 - alpha / 2)).alias("high"))
    value = units.agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0))).alias("value"))
    return value.join(F.broadcast(ends), how="cross").select("value", *[F.when(F.col("value").isNotNull(), F.round(c, 4)).alias(c) for c in ("low", "high")])  # one row each
