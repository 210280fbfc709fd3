"""Changes of the stored tables as pure functions: new rows from old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_kind(notes: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(id, status) of each distinct wanted id: updated, unchanged or not_found."""
    found = wanted.select("id").distinct().join(notes.select("id", "kind", F.lit(True).alias("__known")), "id", "left")
    return found.select("id", F.when(F.col("__known").isNull(), "not_found").when(F.col("kind").eqNullSafe(F.lit(kind)), "unchanged").otherwise("updated").alias("status"))


def with_kind(notes: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """The notes with ``kind`` set on the wanted ids."""
    hit = wanted.select("id").distinct().withColumn("__hit", F.lit(True))
    return notes.join(hit, "id", "left").withColumn("kind", F.when(F.col("__hit"), F.lit(kind)).otherwise(F.col("kind"))).select(*notes.columns)


def append_tag(tags: Column, tag: str) -> Column:
    """a JSON list of tags with ``tag`` at its end unless it is there; null or malformed counts as empty."""
    known = F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.when(F.array_contains(known, tag), known).otherwise(F.array_append(known, tag)))


def soft_delete(notes: DataFrame, gone: DataFrame) -> DataFrame:
    """The notes with those of ``gone`` dormant."""
    return _mark(notes, gone, "state", "dormant")


def _mark(notes: DataFrame, ids: DataFrame, name: str, value: str) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return notes.join(hit, "id", "left").withColumn(name, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(name))).select(*notes.columns)


def strip(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows (chunks, links, mentions) none of whose ``keys`` is in ``gone``."""
    for key in keys:
        rows = rows.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(*rows.columns)
    return rows


def purge(notes: DataFrame) -> DataFrame:
    """The notes that are not dormant; a null state stays."""
    return notes.where(~F.col("state").eqNullSafe(F.lit("dormant")))


def add_links(links: DataFrame, new: DataFrame, notes: DataFrame, both_ways: bool = True) -> DataFrame:
    """Links with (src, dst, link_type, similarity) of ``new`` added or replaced.

    Both ends must be notes and differ; similarity is clamped to 0..1.  Of equal
    new links the strongest counts.
    """
    key = ["src", "dst", "link_type"]
    made = new.where(F.col("src") != F.col("dst")).withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))))
    for end in ("src", "dst"):
        made = made.join(notes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    made = made.select(*key, "similarity")
    if both_ways:
        made = made.unionByName(made.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "link_type", "similarity"))
    made = made.groupBy(*key).agg(F.max("similarity").alias("similarity"))
    return remove_links(links, made, False).select(*key, "similarity").unionByName(made)


def remove_links(links: DataFrame, gone: DataFrame, both_ways: bool = True) -> DataFrame:
    """Links without those of ``gone`` (src, dst, link_type), null types being equal."""
    pairs = gone.select("src", "dst", "link_type")
    if both_ways:
        pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "link_type"))
    p = pairs.distinct().select(*[F.col(c).alias(f"__{c}") for c in pairs.columns])
    same = (F.col("src") == F.col("__src")) & (F.col("dst") == F.col("__dst")) & F.col("link_type").eqNullSafe(F.col("__link_type"))
    return links.join(p, same, "left_anti")


def events_by_id(events: DataFrame, ids: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """The events of ``ids`` (event_id) within the last ``days``."""
    recent = events.where((F.unix_timestamp("ts") >= F.unix_timestamp(now) - days * 86400) & (F.col("ts") <= now))
    return recent.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def override(defaults: DataFrame, given: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """M9: settings of ``given`` (one row a key) where they are not null, else the defaults (one row)."""
    d = defaults.select(*[F.col(f).alias(f"__{f}") for f in fields]).limit(1)
    return given.join(F.broadcast(d), how="left").select(key, *[F.coalesce(f, f"__{f}").alias(f) for f in fields])  # the defaults are one row
