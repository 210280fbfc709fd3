"""The ambient run: what, if anything, each prompt is shown (M5)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import signals as sg
from memlake.functions.text import route_intent
from memlake.operators.gate import gate
from memlake.operators.notes import brief
from memlake.operators.orchestrate import recipes, run_recipe


class Ambient(NamedTuple):
    """``decisions``: one row per prompt; ``shown``: the items of those that inject."""

    decisions: DataFrame
    shown: DataFrame


def routed(prompts: DataFrame) -> DataFrame:
    """Adds ``intent``, ``path`` (silent, temporal, recipe or classic) and ``silence``, the reason for none.

    ``prompts`` has query_id, prompt, enabled, fresh_state and forced (an intent
    that the caller names, else null).  Prompts under three bytes ask nothing; a
    null counts as empty.  Filler without a signal is silent unless an intent
    claims it.
    """
    text = F.coalesce("prompt", F.lit(""))
    quality = sg.prompt_quality(text)
    intent = F.coalesce("forced", route_intent(text, F.coalesce("fresh_state", F.lit(False))))
    early = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").when(F.octet_length(F.trim(text)) < 3, "empty_prompt")
    path = F.when(early.isNotNull(), "silent").when(intent == "temporal_diff", "temporal").when(intent != "general_question", "recipe")
    filler = (quality["contentful"] == 0) & (F.size(quality["signals"]) == 0)
    out = prompts.withColumns({"intent": intent, "vague": quality["vague"]})
    return out.withColumns({"path": F.coalesce(path, F.when(filler, "silent").otherwise("classic")), "silence": F.coalesce(early, F.when(path.isNull() & filler, "no_contentful_tokens"))})


def _fitting(items: DataFrame, budget: DataFrame, always_first: bool) -> DataFrame:
    """(query_id, place, id, tokens) of the first items whose lines fit the budget of their prompt."""
    upto = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    counted = items.join(budget, "query_id").withColumn("tokens", F.ceil(F.sum(F.length(F.coalesce("line", F.lit(""))) + 1).over(upto) / 4).cast("int"))
    fits = F.col("tokens") <= F.col("budget")
    return counted.where(fits | (F.col("place") == 1) if always_first else fits).select("query_id", "place", F.col("id").cast("string").alias("id"), "tokens")


def ambient(spark: SparkSession, prompts: DataFrame, changes: DataFrame, section_hits: DataFrame, hits: DataFrame, brief_tokens: int = 700, classic_tokens: int = 500) -> Ambient:
    """M5: route each prompt to a brief of changes, a recipe of sections or the gated recall, and say why it is silent where it is.

    ``changes`` (query_id, change_id, change_type, importance, line) are those
    of the prompt's time window; ``section_hits`` (query_id, section, id, rank,
    ce, salience, live, line) those of its intent's sections; ``hits``
    (query_id, id, ce, strong, excluded, line) those of its recall.  Each
    prompt's candidates are few, so its windows are small; the number of prompts
    is free.  A brief without changes is shown: no change is an answer.
    """
    known = routed(prompts)
    of = lambda path: known.where(F.col("path") == path)
    plan = recipes(spark)

    news = brief(changes.join(of("temporal").select("query_id"), "query_id", "left_semi"), "query_id", brief_tokens)
    told = news.select("query_id", "place", F.col("change_id").cast("string").alias("id"), F.col("tokens").cast("int").alias("tokens"))

    asked = section_hits.join(of("recipe").select("query_id", "intent"), "query_id")
    order = Window.partitionBy("query_id").orderBy("section", "place")
    picked = run_recipe(asked, plan).join(section_hits.select("query_id", "section", "id", "line"), ["query_id", "section", "id"])
    budget = of("recipe").join(F.broadcast(plan.groupBy("intent").agg(F.max("token_budget").alias("budget"))), "intent").select("query_id", "budget")  # as many rows as RECIPES
    sections = _fitting(picked.withColumn("place", F.row_number().over(order)), budget, False)

    classic = hits.join(of("classic").select("query_id", "vague"), "query_id")
    free = classic.where(~F.coalesce("excluded", F.lit(False)))
    gated = gate(free.select("query_id", "id", "ce", "strong", "vague")).join(free.select("query_id", "id", "line"), ["query_id", "id"])
    recalled = _fitting(gated.withColumn("place", F.col("rank")), of("classic").select("query_id", F.lit(classic_tokens).alias("budget")), True)

    shown = told.unionByName(sections).unionByName(recalled)
    counts = shown.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("tokens"))
    found = classic.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.coalesce("excluded", F.lit(False))).alias("again"))
    all_known = known.join(counts, "query_id", "left").join(found, "query_id", "left")
    n, path = F.coalesce("n", F.lit(0)), F.col("path")
    injects = (path == "temporal") | (n > 0)
    reason = (F.when(path == "silent", F.col("silence")).when(path == "temporal", F.when(n > 0, "changes").otherwise("no_change"))
              .when(path == "recipe", F.when(n > 0, "sections").otherwise("nothing_passed")).when(n > 0, "recalled")
              .when(F.coalesce("found", F.lit(0)) > F.coalesce("again", F.lit(0)), "below_gate").when(F.col("again") > 0, "all_duplicates").otherwise("no_candidates"))
    decisions = all_known.select("query_id", "intent", "path", F.when(injects, "inject").otherwise("silent").alias("decision"), reason.alias("reason"), n.cast("int").alias("n_items"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return Ambient(decisions, shown)
