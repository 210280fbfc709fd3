"""Listings and counters over notes, versions and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How titles of trial notes begin.
TEST_TITLE = r"^(test|tmp|temp|untitled|asdf|foo|bar|hello world)\b"


def recent(notes: DataFrame, limit: int | None = None) -> DataFrame:
    """K1: notes, the last updated first; null dates last, the id settles ties."""
    out = notes.orderBy(F.col("updated_at").desc_nulls_last(), "id")
    return out if limit is None else out.limit(limit)


def changes_since(changes: DataFrame, since: Column, limit: int = 500) -> DataFrame:
    """K2: changes after a time, newest first, ``limit`` at most."""
    return changes.where(F.col("ts") > since).orderBy(F.col("ts").desc(), "id").limit(limit)


def session_start(notes: DataFrame, k: int = 5, agent: str | None = None) -> DataFrame:
    """K3: the ``k`` strongest notes, then the most read; with ``agent``, that agent's newest."""
    if agent is not None:
        return notes.where(F.col("agent_id") == agent).orderBy(F.col("created_at").desc_nulls_last(), "id").limit(k)
    return notes.orderBy(F.col("strength").desc_nulls_last(), F.col("access_count").desc_nulls_last(), "id").limit(k)


def clutter(notes: DataFrame, now: Column, stub_chars: int = 100, test_title: str = TEST_TITLE) -> DataFrame:
    """K4: ``(category, id)``: stub, test_title, never_read (observations of over seven days), duplicate_title.

    A note may be in several.  Titles are compared in lower case; counting them
    is a sum per title with partial sums first, so a title that many share is
    no burden to one task.
    """
    title, read = F.lower(F.trim("title")), F.coalesce("access_count", F.lit(0))
    many = notes.groupBy(title.alias("t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND t <> ''").select("t")
    pick = lambda df, name: df.select(F.lit(name).alias("category"), "id")
    return (
        pick(notes.where((F.length(F.coalesce("content", F.lit(""))) < stub_chars) & (read <= 1)), "stub")
        .unionByName(pick(notes.where(title.rlike(test_title)), "test_title"))
        .unionByName(pick(notes.where((F.col("kind") == "observation") & (read == 0) & (F.col("created_at") < now - F.expr("INTERVAL 7 DAYS"))), "never_read"))
        .unionByName(pick(notes.join(many, title == F.col("t"), "left_semi"), "duplicate_title")))


def version_list(versions: DataFrame, preview: int = 280, limit: int = 50) -> DataFrame:
    """K5: each note's versions, the newest first, ``limit`` a note, with the first characters of each."""
    order = Window.partitionBy("id").orderBy(F.col("version").desc())
    kept = versions.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return kept.select("id", "version", "place", F.left("content", F.lit(preview)).alias("preview"), F.length("content").alias("chars"))


def version_at(versions: DataFrame, note: int, version: int) -> DataFrame:
    """K5: one version whole."""
    return versions.where((F.col("id") == note) & (F.col("version") == version))


def status_counts(notes: DataFrame) -> DataFrame:
    """A2: ``(state, memories, chars)`` by state; a null state is ``fresh``."""
    return notes.groupBy(F.coalesce("state", F.lit("fresh")).alias("state")).agg(F.count(F.lit(1)).alias("memories"), F.sum(F.length("content")).alias("chars"))


def status_totals(**tables: DataFrame) -> DataFrame:
    """A2: ``(name, n)``: the rows of each table given."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def consolidate_queue(notes: DataFrame, facts: DataFrame) -> DataFrame:
    """Notes that no fact comes from; facts without a source do not hide any."""
    return notes.join(facts.where(F.col("source_id").isNotNull()).select(F.col("source_id").alias("id")), "id", "left_anti")
