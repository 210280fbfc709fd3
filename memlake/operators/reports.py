"""Listings, inboxes, the work queue, observations and writes by memory."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions import text as tx
from memlake.operators.history import latest
from memlake.operators.notes import visible

#: Events that become observations, and tools that change files.
OBSERVED = ["SessionStart", "UserPromptSubmit", "PostToolUse", "SessionEnd"]
MUTATING = ["edit", "write", "notebookedit", "multiedit"]
REMEMBER_BYTES = 32 * 1024


def lifecycle_verdict(state: Column, superseded_by: Column) -> Column:
    """Why a note no longer counts, or null."""
    gone = F.coalesce(superseded_by.cast("string") != "", F.lit(False))
    return F.when(gone, "superseded").when(state.isin("archived", "rejected"), state).when(state == "dormant", "deleted")


def contradictions(pairs: DataFrame, notes: DataFrame, live_only: bool = False, resolved: bool | None = False) -> DataFrame:
    """Pairs (id, a, b, fact_a, fact_b, resolved, detected_at) with both titles and claims; newest first when ordered by detected_at.

    A claim is the fact, or the title where that is blank, at 200 characters.
    ``live_only`` needs both notes visible.
    """
    shown = visible(notes) if live_only else notes
    out = pairs if resolved is None else pairs.where(F.coalesce("resolved", F.lit(False)) == resolved)
    for side in "ab":
        out = out.join(shown.select(F.col("id").alias(side), F.col("title").alias(f"title_{side}")), side)
        fact = F.when(F.coalesce(F.col(f"fact_{side}"), F.lit("")).rlike(r"\S"), F.col(f"fact_{side}")).otherwise(F.col(f"title_{side}"))
        out = out.withColumn(f"claim_{side}", F.left(fact, F.lit(200)))
    return out.select("id", "a", "title_a", "claim_a", "b", "title_b", "claim_b", "detected_at")


def _meets(pattern: str | None, agent: str | None) -> bool:
    try:
        return agent is not None and re.search(pattern or "", agent) is not None
    except re.error:
        return False


@F.pandas_udf(T.BooleanType())
def _matches(pattern: pd.Series, agent: pd.Series) -> pd.Series:
    return pd.Series([_meets(p, a) for p, a in zip(pattern, agent)], dtype=bool)


def agent_matches(pattern: Column, agent: Column) -> Column:
    """whether a todo's pattern is found in an agent's name; a null or blank one meets all, an invalid one none.

    Python tries the pattern, since an invalid one would end a JVM expression's job.
    """
    return ~F.coalesce(pattern, F.lit("")).rlike(r"\S") | _matches(pattern, agent)


def agent_inbox(todo_log: DataFrame, agent: str, handoffs_only: bool = False) -> DataFrame:
    """K8: the open todos that ``agent`` may take, from the log's last row per todo; order by created_at for display."""
    todos = latest(todo_log, "id", ["position"]).where("status = 'open'")
    if handoffs_only:
        todos = todos.where(F.col("kind").isNotNull())
    return todos.where(agent_matches(F.col("agent_match"), F.lit(agent)))


def log_tail(log: DataFrame, k: int, **equal: str) -> DataFrame:
    """K9: the ``k`` newest rows of a log by (ts, id), where the named columns have these values; a top-k report."""
    kept = reduce(lambda d, x: d.where(F.col(x[0]) == x[1]), equal.items(), log)
    return kept.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(k)


def work_queue(duplicates: DataFrame, conflicts: DataFrame, orphans: DataFrame, known: DataFrame, each: int = 20) -> DataFrame:
    """(kind, key) of new work, at most ``each`` of a kind looked at per pass, none whose key is ``known``.

    ``duplicates`` has (id), ``conflicts`` (id, detected_at), ``orphans`` (src, target).
    Null ids and targets make no work.  The limit is the feature: the next pass takes up the rest.
    """
    made = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("key"))
    text = lambda c: F.col(c).cast("string")
    dup = made(duplicates.where("id IS NOT NULL").orderBy("id").limit(each), "duplicate", F.concat(F.lit("dup:"), text("id")))
    con = made(conflicts.orderBy(F.col("detected_at").desc(), "id").limit(each), "contradiction", F.concat(F.lit("contra:"), text("id")))
    orp = made(orphans.where("src IS NOT NULL AND target IS NOT NULL").orderBy("src", "target").limit(each), "orphan", F.concat(F.lit("orphan:"), text("src"), F.lit(":"), text("target")))
    return dup.unionByName(con).unionByName(orp).distinct().join(known.select("key"), "key", "left_anti").select("kind", "key")


def merge_changes(journal: DataFrame, state: DataFrame, weight: str = "weight", tie: str = "ts") -> DataFrame:
    """The strongest change of each (object_type, object_id); ``state`` fills in where the journal has none.  Adds ``backfill``."""
    key = ["object_type", "object_id"]
    missing = state.join(journal.select(*key).distinct(), key, "left_anti").withColumn("backfill", F.lit(True))
    both = journal.withColumn("backfill", F.lit(False)).unionByName(missing.select(*journal.columns, "backfill"))
    w = Window.partitionBy(*key).orderBy(F.col(weight).desc(), F.col(tie), "change_type")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def harness_metrics(results: DataFrame) -> DataFrame:
    """One row over (first_hit_rank, latency_ms): n, hit@1/3/5/10, MRR, median and 95th percentile (the maximum below 20 rows)."""
    rank = F.col("first_hit_rank")
    share = lambda k: F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"hit_{k}")
    p95 = F.when(F.count(F.lit(1)) >= 20, F.percentile("latency_ms", F.lit(0.95))).otherwise(F.max("latency_ms"))
    return results.agg(F.count(F.lit(1)).alias("n"), *[share(k) for k in (1, 3, 5, 10)], F.coalesce(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), F.lit(0.0)).alias("mrr"),
                       F.percentile("latency_ms", F.lit(0.5)).alias("median_ms"), p95.alias("p95_ms"))


def _clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def observe(hooks: DataFrame, tool_mode: str = "mutations") -> DataFrame:
    """Adds ``status``, ``title`` and ``markdown`` to (event, payload: JSON text).

    Unknown events are skipped; so are tool calls that change no file in mode
    ``mutations``, and all of them in mode ``off``.  Private blocks are taken
    out of prompts, outputs and summaries.  A malformed payload counts as empty.
    """
    field = lambda *names: F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in names])
    or_ = lambda c, v: F.coalesce(c, F.lit(v))
    e = F.col("event")
    session, at = or_(field("session_id", "sessionId"), "unknown"), or_(field("timestamp"), "unknown")
    short = F.left(session, F.lit(8))
    tool = field("tool_name", "tool")
    status = (F.when(~F.coalesce(e.isin(OBSERVED), F.lit(False)), "skipped_unknown_event").when((e == "PostToolUse") & F.lit(tool_mode == "off"), "skipped_posttooluse_off")
              .when((e == "PostToolUse") & F.lit(tool_mode == "mutations") & ~F.lower(or_(tool, "")).isin(MUTATING), "skipped_non_mutation").otherwise("observed"))
    prompt, summary = tx.strip_private(or_(field("prompt"), "")), tx.strip_private(or_(field("summary"), ""))
    output = _clip(tx.strip_private(or_(field("tool_response", "output"), "")), 2000)
    one_line = _clip(F.trim(F.regexp_replace(prompt, r"\s+", " ")), 60)
    title = (F.when(e == "SessionStart", F.concat(F.lit("Session start · "), short)).when(e == "UserPromptSubmit", F.concat(F.lit("User prompt · "), one_line))
             .when(e == "PostToolUse", F.concat(or_(tool, "unknown"), F.lit(" · "), short)).otherwise(F.concat(F.lit("Session end · "), short)))
    head = F.concat(F.lit("**Event:** "), e, F.lit("\n**Session:** `"), session, F.lit("`\n"))
    body = (F.when(e == "SessionStart", F.concat(F.lit("**Started:** "), at, F.lit("\n**Cwd:** `"), or_(field("cwd"), "?"), F.lit("`\n")))
            .when(e == "UserPromptSubmit", F.concat(F.lit("**Time:** "), at, F.lit("\n\n## Prompt\n\n"), prompt, F.lit("\n")))
            .when(e == "PostToolUse", F.concat(F.lit("**Tool:** `"), or_(tool, "unknown"), F.lit("`\n**Time:** "), at, F.lit("\n\n## Input\n\n```json\n"), _clip(or_(field("tool_input"), ""), 1500),
                                               F.lit("\n```\n\n## Output\n\n```\n"), output, F.lit("\n```\n")))
            .otherwise(F.concat(F.lit("**Ended:** "), at, F.lit("\n"), F.when(summary != "", F.concat(F.lit("\n## Summary\n\n"), summary, F.lit("\n"))).otherwise(""))))
    out = hooks.withColumn("status", status)
    seen = F.col("status") == "observed"
    return out.select(*hooks.columns, "status", F.when(seen, title).alias("title"), F.when(seen, F.concat(head, body)).alias("markdown"))


def remember_plan(asked: DataFrame, nearest: DataFrame, notes: DataFrame, low: float = 0.82, high: float = 0.92) -> DataFrame:
    """(request_id, status, title, merged_into, conflict_with, similarity) of (request_id, title, content, deduplicate, supersedes).

    ``nearest`` has the best match (request_id, id, similarity) of each request,
    or no row.  At its threshold or above the request is ``merged``; otherwise it
    is ``created``, with a heads-up for a match in [low, high) that is live and not
    among the notes it supersedes.  Content over 32 KB is ``too_large``.  A title
    that is not given comes from the first line.
    """
    first = F.trim(F.regexp_replace(F.trim(F.element_at(F.split(F.coalesce("content", F.lit("")), r"\r?\n"), 1)), r"\A#+", ""))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.left(first, F.lit(60)), F.lit("")), F.lit("Untitled"))
    live = notes.where("superseded_by IS NULL").select("id", F.lit(True).alias("__live"))
    x = asked.withColumn("__title", title).join(nearest.select("request_id", "id", "similarity"), "request_id", "left").join(live, "id", "left")
    merged = F.coalesce(F.col("similarity") >= F.col("deduplicate"), F.lit(False))
    status = F.when(F.octet_length("content") > REMEMBER_BYTES, "too_large").when(merged, "merged").otherwise("created")
    replaced = F.coalesce(F.array_contains("supersedes", F.col("id")), F.lit(False))
    warns = (status == "created") & (F.col("similarity") >= low) & (F.col("similarity") < high) & F.col("__live") & ~replaced
    return x.select("request_id", status.alias("status"), F.col("__title").alias("title"), F.when(status == "merged", F.col("id")).alias("merged_into"), F.when(warns, F.col("id")).alias("conflict_with"),
                    F.when((status == "merged") | warns, F.round("similarity", 3)).alias("similarity"))
