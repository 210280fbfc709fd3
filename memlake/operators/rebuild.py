"""Derived tables made anew, the trash, and playbook rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import typed_wikilinks
from memlake.operators.ingest import chunk_notes, clip_bytes, resolve_wikilinks

LIVE = "state IS DISTINCT FROM 'dormant'"


def rebuild_wikilinks(notes: DataFrame, links: DataFrame) -> DataFrame:
    """The links of live notes (id, filename, title, content, state) read from their texts anew.

    ``links`` has src, dst, link_type, similarity and ``from_text``; rows not
    from the text stay as they are.  A link without a type is ``manual``.
    """
    live = notes.where(LIVE)
    named = live.select("id", F.explode(typed_wikilinks(F.coalesce("content", F.lit("")))).alias("l")).select("id", F.col("l.target").alias("target"), F.coalesce("l.link_type", F.lit("manual")).alias("link_type")).distinct()
    found = resolve_wikilinks(named, live).where("target_id IS NOT NULL AND target_id <> id")
    made = found.select(F.col("id").alias("src"), F.col("target_id").alias("dst"), "link_type", F.lit(1.0).alias("similarity"), F.lit(True).alias("from_text")).distinct()
    return links.where("NOT from_text").select(*made.columns).unionByName(made)


def rebuild_chunks(notes: DataFrame, embed: Column | None = None) -> DataFrame:
    """The chunks of live notes (id, content, state) made anew; ``embed`` is a vector expression over ``embed_text``, a pandas UDF for instance."""
    chunks = chunk_notes(notes.where(LIVE))
    return chunks if embed is None else chunks.withColumn("embedding", embed)


def reset(*tables: DataFrame) -> list[DataFrame]:
    """The tables without rows, their columns kept."""
    return [t.where(F.lit(False)) for t in tables]


def trash(notes: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """The notes with those of ``gone`` (id) dormant and ``deleted_at`` set; notes in the trash keep their time."""
    hit = gone.select("id").distinct().withColumn("__gone", F.lit(True))
    at = F.when(F.col("__gone"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))
    state = F.when(F.col("__gone"), F.lit("dormant")).otherwise(F.col("state"))
    return notes.join(hit, "id", "left").withColumns({"deleted_at": at, "state": state}).select(*notes.columns)


def trash_list(notes: DataFrame) -> DataFrame:
    """What is in the trash, the last deleted first."""
    size = F.octet_length(F.coalesce("content", F.lit(""))).alias("size")
    return notes.where("deleted_at IS NOT NULL").select("id", "filename", "title", "deleted_at", size).orderBy(F.col("deleted_at").desc(), "id")


def restore(notes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes with those of ``wanted`` (id) fresh again, and (id, status): restored, name_taken, not_in_trash or not_found.

    A note comes back only while no live note has its file name; of several of
    one name, the last deleted does.
    """
    ask = wanted.select("id").distinct()
    held = notes.where(LIVE).select("filename").distinct().withColumn("__taken", F.lit(True))
    known = ask.join(notes.select("id", "filename", "deleted_at", F.lit(True).alias("__known")), "id", "left").join(held, "filename", "left")
    can = known.where("deleted_at IS NOT NULL AND __taken IS NULL")
    last = can.groupBy("filename").agg(F.max_by("id", F.struct("deleted_at", "id")).alias("id")).select("id", F.lit(True).alias("__back"))
    judged = known.join(last, "id", "left")
    status = F.when(F.col("__known").isNull(), "not_found").when(F.col("deleted_at").isNull(), "not_in_trash").when(F.col("__back"), "restored").otherwise("name_taken")
    out = notes.join(last, "id", "left").withColumns({
        "state": F.when(F.col("__back"), F.lit("fresh")).otherwise(F.col("state")), "deleted_at": F.when(~F.coalesce("__back", F.lit(False)), F.col("deleted_at"))})
    return out.select(*notes.columns), judged.select("id", status.alias("status"))


def playbook_rules(corrections: DataFrame, now: Column) -> DataFrame:
    """M8: corrections (id, rule, room, title) as notes: (id, filename, title, content, kind, importance, confidence, room, after).

    Rules under eight bytes are left out.  ``after`` is the start that the
    journal shows.  File names end in a digest of id and rule, so the same
    correction gives the same note.
    """
    rule = F.trim(F.coalesce("rule", F.lit("")))
    room = F.nullif(F.col("room"), F.lit(""))
    c = corrections.where(F.octet_length(rule) >= 8).withColumns({"rule": rule, "room": room, "title": F.coalesce("title", F.concat(F.lit("Rule: "), F.left(rule, F.lit(60))))})
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", "-"), r"\A-+|-+\z", "")
    digest = F.left(F.sha2(F.concat_ws("\u0001", F.col("id").cast("string"), "rule"), 256), F.lit(8))
    folder = F.coalesce(F.concat("room", F.lit("/playbook")), F.lit("playbook"))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # The fields of a rule's head and what a correction sets them to.
    head = F.concat_ws("\n", F.lit("---"), F.lit("nv_type: playbook_rule"), F.concat(F.lit("scope: "), "room"), F.lit("category: framing"), F.lit("source: user_correction"), F.lit("importance: high"), F.lit("confidence: 0.95"),
                       F.concat(F.lit("last_confirmed_at: "), stamp), F.lit("---"))
    return c.select(
        "id", F.concat(folder, F.lit("/"), clip_bytes(slug, 48), F.lit("-"), digest, F.lit(".md")).alias("filename"), "title", F.concat(head, F.lit("\n# "), "title", F.lit("\n\n"), "rule", F.lit("\n")).alias("content"),
        F.lit("preference").alias("kind"), F.lit("high").alias("importance"), F.lit(0.95).alias("confidence"), "room", F.left("rule", F.lit(160)).alias("after"))


def graph_key(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``key`` that any change of the nodes (id) or edges (src, dst) changes, whatever their order; no row leaves its task but as a sum."""
    digest = lambda df, *cols: df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), *cols), F.lit(1 << 31))).alias("s"))
    a, b = digest(nodes, "id"), digest(edges, "src", "dst")
    both = a.select(F.concat_ws(":", "n", "x", "s").alias("a")).join(b.select(F.concat_ws(":", "n", "x", "s").alias("b")), how="cross")  # one row each
    return both.select(F.sha2(F.concat_ws("|", "a", "b"), 256).alias("key"))
