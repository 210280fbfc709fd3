"""Notes: filters, detail, replacement, clusters and briefs (P1-P4, F14, F15, F29, J11, J17, T-3, T-6, G8)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that turn, weigh up or weaken a statement.
MARKERS = {
    "negation": ["not", "n't", "never", "no", "none", "cannot", "without", "neither", "nor", "avoid", "stop", "don't", "doesn't", "won't", "shouldn't", "can't"],
    "comparison": ["instead of", "rather than", "as opposed to", "versus"],
    "modality": ["might", "may", "could", "maybe", "perhaps", "possibly", "probably", "potentially", "considering", "thinking about", "we should", "should we", "proposed", "option", "idea", "wondering"],
}
#: Further words that the gates look for, with those above.
GATE_MARKERS = {
    **MARKERS,
    "quotation": ["wrote:", "writes:", "said:", "says:", "quote:", "forwarded", "fwd:", "pasted", "according to", "email from", "message from", "as per"],
    "conditional": ["unless", "except", "if", "provided that", "as long as", "in case", "otherwise", "only when", "only if", "depending on"],
    "completion": ["was", "were", "has been", "have been", "had been", "completed", "finished", "shipped", "already", "no longer"],
    "planned": ["will", "i'll", "we'll", "going to", "plan to", "plans to", "planning to", "tomorrow", "next week", "next month", "next quarter", "soon", "later", "might", "may", "could", "intend to"],
    "time_scope": ["used to", "previously", "formerly", "historically", "back then", "at the time", "until", "last year", "last month", "last quarter", "no longer", "for now", "temporarily"],
}
#: The sections of a brief, in order, with the kinds of change in each.
SECTIONS = [
    ("Decisions", ["decision_added", "approved", "rejected"]),
    ("Tasks and deadlines", ["task_created", "task_claimed", "task_completed", "deadline_changed", "priority_changed", "owner_changed", "resolved"]),
    ("Risks", ["risk_changed"]),
    ("Files and sources", ["source_added"]),
    ("Playbook and memory", ["playbook_rule_added", "superseded", "confidence_changed", "archived"]),
    ("Agent activity", ["agent_run_completed"]),
    ("Other changes", ["created", "updated", "working_state_updated"]),
]
OPERATORS = ("kind", "folder", "state", "entity", "after", "before", "agent")


def marker_pattern(kind: str) -> str:
    """one pattern for all words of a list, each apart from letters and digits; contractions end a word."""
    words = sorted(GATE_MARKERS[kind], key=len, reverse=True)
    apart = "|".join(w for w in words if w != "n't")
    return rf"(^|[^a-z0-9])({apart})($|[^a-z0-9])" + (r"|[a-z]n't($|[^a-z0-9])" if "n't" in words else "")


def has_marker(text: Column, kind: str) -> Column:
    return F.coalesce(F.lower(text).rlike(marker_pattern(kind)), F.lit(False))


def parse_query(text: str) -> tuple[str, dict[str, str]]:
    """(free text, operators); an operator without a value, or with a bad date, stays free text."""
    free, found = [], {}
    for word in text.split():
        name, colon, value = word.partition(":")
        name = name.lower()
        ok = bool(colon and value and name in OPERATORS)
        if ok and name in ("after", "before"):
            ok = re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) is not None
            try:
                ok = ok and bool(dt.date.fromisoformat(value))
            except ValueError:
                ok = False
        if ok:
            found[name] = value
        else:
            free.append(word)
    return " ".join(free), found


def visible(notes: DataFrame) -> DataFrame:
    """Notes that are not dormant and not replaced."""
    return notes.where(~F.coalesce(F.col("state") == "dormant", F.lit(False)) & F.col("superseded_by").isNull())


def apply_filters(notes: DataFrame, operators: dict[str, str], mentions: DataFrame | None = None, as_of: Column | None = None, exclude_kinds: tuple[str, ...] = ("observation",)) -> DataFrame:
    """Operator filters, creation cut-off, and kinds left out unless asked for by name."""
    keep = F.lit(True)
    same = lambda c, v: F.lower(F.col(c)) == v.lower()
    for name, column in (("kind", "kind"), ("state", "state"), ("agent", "agent_id")):
        if name in operators:
            keep = keep & same(column, operators[name])
    if "folder" in operators:
        keep = keep & F.lower("filename").startswith(operators["folder"].strip("/").lower() + "/")
    if "after" in operators:
        keep = keep & (F.col("created_at") >= F.lit(operators["after"]).cast("timestamp"))
    if "before" in operators:
        keep = keep & (F.col("created_at") < F.lit(operators["before"]).cast("timestamp"))
    if as_of is not None:
        keep = keep & (F.col("created_at") <= as_of)
    if exclude_kinds and "kind" not in operators:
        keep = keep & ~F.coalesce(F.col("kind").isin(*exclude_kinds), F.lit(False))
    out = notes.where(keep)
    if "entity" in operators:
        if mentions is None:
            raise ValueError("an entity filter needs the table of mentions")
        out = out.join(mentions.where(F.lower("name") == operators["entity"].lower()).select("id"), "id", "left_semi")
    return out


def note_detail(notes: DataFrame, children: DataFrame, key: str, order: list[str], payload: list[str], out: str) -> DataFrame:
    """Each note with its ``out`` rows (links, entities) as a sorted array, empty if it has none."""
    held = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *payload))).alias(out))
    return notes.join(held, key, "left").withColumn(out, F.coalesce(out, F.array().cast(held.schema[out].dataType)))


def supersede(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """T-3: sets ``superseded_by`` by (old_id, new_id); a note never replaces itself, and both notes must exist; the least new id wins."""
    real = pairs.where("old_id <> new_id").join(notes.select(F.col("id").alias("new_id")), "new_id", "left_semi")
    newest = real.groupBy(F.col("old_id").alias("id")).agg(F.min("new_id").alias("__new"))
    return notes.join(newest, "id", "left").withColumn("superseded_by", F.coalesce("__new", "superseded_by")).drop("__new")


def cluster_summaries(members: DataFrame, top: int = 5) -> DataFrame:
    """``(cluster, size, titles)``: the titles of the members of highest rank."""
    order = Window.partitionBy("cluster").orderBy(F.col("rank").desc(), "id")
    best = members.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top)
    titles = best.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "title"))), lambda x: x["title"]).alias("titles"))
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(titles, "cluster")


def brief(changes: DataFrame, scope: str, max_tokens: int, floor: float = 0.30, top: int = 3) -> DataFrame:
    """T-6: the lines of each scope's brief, in order, with the tokens used so far.

    ``changes`` has ``scope``, change_id, change_type, importance and line.  The
    ``top`` most important lead; the rest follow under the fixed sections.
    Lines are taken while they fit (whole lines, where a rendered block would be
    cut inside one).
    """
    section = F.lit(len(SECTIONS))
    for i, (_, kinds) in reversed(list(enumerate(SECTIONS, 1))):
        section = F.when(F.col("change_type").isin(kinds), i).otherwise(section)
    by_weight = Window.partitionBy(scope).orderBy(F.round("importance", 9).desc(), "change_id")
    ranked = changes.where(F.col("importance") >= floor).withColumn("__r", F.row_number().over(by_weight))
    ranked = ranked.withColumn("section_no", F.when(F.col("__r") <= top, 0).otherwise(section))
    shown = Window.partitionBy(scope).orderBy("section_no", "__r")
    out = ranked.withColumns({
        "place": F.row_number().over(shown), "tokens": F.floor(F.sum(F.length("line") + 1).over(shown.rowsBetween(Window.unboundedPreceding, 0)) / 4)})
    title = F.element_at(F.array(F.lit("Most important changes"), *[F.lit(n) for n, _ in SECTIONS]), F.col("section_no") + 1)
    return out.where(F.col("tokens") <= max_tokens).select(scope, "place", title.alias("section"), "change_id", "line", "tokens")
