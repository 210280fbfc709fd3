"""Multi-section recall and score adjustments from facts, rank and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.text import CURRENCY, light_stem, tokenize
from memlake.operators.fact_cells import adjust

#: Sections of each intent (intent, section, title, source, most items, floor; null: the intent's own), token budget, floor.
RECIPES = [
    ("continue_work", 1, "Current situation", "working_state", 1, None, 400, 0.60),
    ("continue_work", 2, "Open tasks", "open_tasks", 3, None, 400, 0.60),
    ("prepare_brief", 1, "Current situation", "working_state", 1, None, 900, 0.50),
    ("prepare_brief", 2, "Relevant decisions", "decisions", 3, 0.0, 900, 0.50),
    ("prepare_brief", 3, "Open tasks", "open_tasks", 5, None, 900, 0.50),
    ("prepare_brief", 4, "Playbook rules", "playbook_rules", 3, None, 900, 0.50),
    ("prepare_brief", 5, "Background", "semantic", 3, None, 900, 0.50),
    ("draft_output", 1, "Playbook rules", "playbook_rules", 4, None, 700, 0.50),
    ("draft_output", 2, "Relevant decisions", "decisions", 2, 0.0, 700, 0.50),
    ("draft_output", 3, "Background", "semantic", 3, None, 700, 0.50),
    ("review_risks", 1, "Open tasks and blockers", "open_tasks", 5, None, 700, 0.50),
    ("review_risks", 2, "Relevant decisions", "decisions", 3, 0.0, 700, 0.50),
    ("review_risks", 3, "Playbook rules", "playbook_rules", 2, None, 700, 0.50),
    ("review_risks", 4, "Background", "semantic", 3, None, 700, 0.50),
    ("explain_decision", 1, "Decisions", "decisions", 4, None, 700, 0.45),
    ("explain_decision", 2, "Sources", "sources", 3, None, 700, 0.45),
    ("find_source", 1, "Sources", "sources", 5, None, 700, 0.35),
]

#: Queries and facts of a cell of ``fact_adjustment``, on average, at most.
ASKED_IN_CELL, FACTS_IN_CELL = 8192, 250_000


def recipes(spark: SparkSession) -> DataFrame:
    """M2: the table of sections, with ``quota``: sections filled by salience first; 17 rows."""
    shape = "intent string, section int, title string, source string, max_items int, own_floor double, token_budget int, ce_floor double"
    rules = F.col("source") == "playbook_rules"
    return spark.createDataFrame(RECIPES, shape).withColumns({
        "quota": rules | (F.coalesce("own_floor", F.lit(1.0)) == 0.0), "floor": F.coalesce("own_floor", F.when(rules, 0.0).otherwise(F.col("ce_floor")))})


def run_recipe(hits: DataFrame, plan: DataFrame, pool_cap: int = 24) -> DataFrame:
    """M3: the items of each query's sections, ``place`` from 1.

    ``hits`` has query_id, intent, section, id, rank (in the section's recall),
    ce, salience, and ``live`` (false: superseded, archived or the like).  A hit
    belongs to the first section that recalls it.  The first ``pool_cap`` of a
    query's hits, by section and rank, carry their ``ce``; the others count 0.
    Quota sections order by salience, the rest by ``ce``; items under the
    section's floor are left out.
    """
    first = Window.partitionBy("query_id", "id").orderBy("section", "rank")
    seen = hits.where("live").withColumn("__first", F.row_number().over(first)).where("__first = 1")
    pooled = seen.withColumn("__pool", F.row_number().over(Window.partitionBy("query_id").orderBy("section", "rank", "id")))
    scored = pooled.withColumn("ce", F.when(F.col("__pool") <= pool_cap, F.coalesce("ce", F.lit(0.0))).otherwise(0.0))
    j = scored.join(F.broadcast(plan.select("intent", "section", "title", "max_items", "quota", "floor")), ["intent", "section"])  # as many rows as RECIPES
    lead, then = F.when(F.col("quota"), F.col("salience")).otherwise(F.col("ce")), F.when(F.col("quota"), F.col("ce")).otherwise(F.col("salience"))
    order = Window.partitionBy("query_id", "section").orderBy(F.round(lead, 9).desc(), F.round(then, 9).desc(), "__pool")
    out = j.where(F.col("ce") >= F.col("floor")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("max_items"))
    return out.select("query_id", "intent", "section", "title", "id", "ce", "salience", "place")


def fact_adjustment(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """``(query_id, id, boost, demote)``: what facts add to, or take from, their notes.

    ``queries`` has query_id and q; ``facts`` subject, attribute, value, id (its
    note) and current.  A fact matches when the query holds all tokens of its
    subject.  Its note gains 0.25 if it is the subject's only current match, or
    shares most words with the query beyond the subject.  When the query asks
    for what holds now, notes of replaced facts lose 0.15.

    Matches may be as many as pairs, so none is shuffled: queries in blocks and
    facts in blocks of whole subjects meet in cells, which put out what counts.
    Only matches of notes that have several facts, or of queries that share an
    id, are summed afterwards.
    """
    tally = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    (n_asked, same_id), (n_facts, same_note) = tally(queries, "query_id"), tally(facts, "id")
    high = max(1, -(-n_asked // ASKED_IN_CELL), min(4 * queries.sparkSession.sparkContext.defaultParallelism, n_asked // 64))
    wide = max(1, -(-n_facts // FACTS_IN_CELL))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.array().cast("array<string>")
    tokens = F.coalesce(tokenize(F.col("q")), none)
    asked = queries.select("query_id", F.array_distinct(tokens).alias("words"), F.coalesce(F.col("q").rlike(CURRENCY), F.lit(False)).alias("flag"))
    asked = asked.withColumn("stems", F.array_distinct(F.transform("words", light_stem)))
    av = F.concat(tokenize(F.coalesce("attribute", F.lit(""))), tokenize(F.coalesce("value", F.lit(""))))
    known = facts.where("subject IS NOT NULL AND current IS NOT NULL").select("subject", "id", F.col("current").alias("flag"), F.array_distinct(tokenize(F.col("subject"))).alias("words"), av.alias("av"))
    beyond = F.when(F.col("flag"), F.array_except(F.transform("av", light_stem), F.transform("words", light_stem))).otherwise(none)
    known = known.where(F.size("words") > 0).select("subject", "id", "flag", "words", beyond.alias("stems"))
    rows = known.select("*", F.lit(True).alias("fact"), block("subject", wide).alias("x"), every(high).alias("y")).unionByName(
        asked.select("*", F.lit(False).alias("fact"), block("query_id", high).alias("y"), every(wide).alias("x")), allowMissingColumns=True)
    dealt = rows.withColumn("cell", F.col("y") * wide + F.col("x")).drop("x", "y").repartitionById(high * wide, "cell")
    kind = lambda df, c: T.StructField(c, df.schema[c].dataType)
    out = dealt.mapInArrow(adjust, T.StructType([kind(queries, "query_id"), kind(facts, "id"), T.StructField("boost", T.DoubleType()), T.StructField("demote", T.DoubleType())]))
    return out if max(same_id, same_note) < 2 else out.groupBy("query_id", "id").agg(F.sum("boost").alias("boost"), F.sum("demote").alias("demote"))


def apply_facts(scores: DataFrame, adjustment: DataFrame) -> DataFrame:
    """The boost may bring in a note that no channel found; the loss only touches notes with a score."""
    both = scores.select("query_id", "id", "score").join(adjustment, ["query_id", "id"], "full_outer").where(F.col("score").isNotNull() | (F.col("boost") > 0))
    return both.select("query_id", "id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0)) - F.coalesce("demote", F.lit(0.0))).alias("score"))


def apply_rank(scores: DataFrame, pagerank: DataFrame) -> DataFrame:
    """Score times 1 + 0.15 ln(1 + pagerank); notes without a rank keep their score."""
    factor = 1.0 + 0.15 * F.log(1.0 + F.greatest(F.col("pagerank"), F.lit(0.0)))
    return scores.join(pagerank.select("id", "pagerank"), "id", "left").withColumn("score", F.col("score") * F.coalesce(factor, F.lit(1.0))).drop("pagerank")


def title_boost(similarities: DataFrame, floor: float = 0.45, k: int = 10, weight: float = 0.15) -> DataFrame:
    """``boost`` = weight x cosine of query and title, for the ``k`` best above the floor of each query's pool."""
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    kept = similarities.where(F.col("similarity") > floor).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.select("query_id", "id", (F.col("similarity") * weight).alias("boost"))
