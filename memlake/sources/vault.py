"""Folders of Markdown notes and the monthly journal.

Spark's file sources pass over files of no bytes, so such notes are not seen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from memlake.functions import text as tx
from memlake.operators.ingest import upsert_plan

NOTE_FILES = "*.md"
EVENT = "event_id string, seq long, ts string, brain_id string, room string, event_type string, object_type string, object_id string, title string, before string, after string, privacy_label string, session_id string, source_refs array<string>"


def _named(files: DataFrame, folder: str) -> DataFrame:
    """Files as notes: path below ``folder``, text, title (the file's name if there is no heading), kind and hash."""
    path = F.url_decode(F.replace(F.col("__path"), F.lit("+"), F.lit("%2B")))
    root = folder.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    name = F.substring_index(path, root, -1)
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.md\z", "")
    title = F.coalesce(F.nullif(tx.extract_title(F.col("value")), F.lit("")), F.replace(stem, F.lit("-"), F.lit(" ")))
    return files.select(name.alias("filename"), F.col("value").alias("content"), title.alias("title"), tx.infer_kind(name).alias("kind"), tx.content_hash(F.col("value")).alias("content_hash"))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, content, title, kind, content_hash) of all ``.md`` files below ``folder``."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=NOTE_FILES, recursiveFileLookup=True)
    return _named(files.select("value", F.col("_metadata.file_path").alias("__path")), folder)


def import_counts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Number of files by what an import does with them; unchanged ones are skipped."""
    return upsert_plan(current, incoming).groupBy("action").agg(F.count(F.lit(1)).alias("files"))


def watch_notes(spark: SparkSession, folder: str, handle, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each batch of new files to ``handle(notes, batch_id)``; the trigger interval is the debounce.

    Without ``every`` what is there is handled and the query ends.
    """
    files = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).format("text").option("wholetext", True).option("pathGlobFilter", NOTE_FILES).option("recursiveFileLookup", True).load(folder)
    notes = _named(files.select("value", F.col("_metadata.file_path").alias("__path")), folder)
    run = notes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (run.trigger(processingTime=every) if every else run.trigger(availableNow=True)).start()


def vault_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row (notes, bytes, newest) of the ``.md`` files below ``folder``, from metadata only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", NOTE_FILES).option("recursiveFileLookup", True).load(folder)
    return files.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modificationTime").alias("newest"))


def _private_path(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(?i)(?:\A|[/\\])(?:_private(?:[/\\]|\z)|\.)"), F.lit(False))


def is_private(room: Column, object_type: Column, object_id: Column, title: Column, label: Column) -> Column:
    """A sensitive label, or a part of a path that is private or starts with a point; nulls are not private."""
    note = F.coalesce(object_type == "engram", F.lit(False))
    return F.coalesce(F.lower(label) == "sensitive", F.lit(False)) | _private_path(room) | (note & _private_path(object_id)) | _private_path(title)


def write_journal(events: DataFrame, folder: str, cap: int = 2000) -> None:
    """Append events as JSON lines under one folder a month; private ones are left out, long before and after texts are cut."""
    known = events.where(~is_private(*[F.col(c) for c in ("room", "object_type", "object_id", "title", "privacy_label")]))
    cut = known.withColumns({c: F.left(c, F.lit(cap)) for c in ("before", "after")}).withColumn("month", F.coalesce(F.nullif(F.left("ts", F.lit(7)), F.lit("")), F.lit("unknown")))
    cut.write.mode("append").partitionBy("month").json(folder)


def read_journal(spark: SparkSession, folder: str, start: dt.datetime, end: dt.datetime, room: str | None = None) -> DataFrame:
    """Events from ``start`` to ``end`` (both included, UTC) with ``at``; only the months between are read.

    Malformed lines and times are left out.  A room keeps its own events, those
    of notes in its folder, and those of no room.  Order by (at, seq) for display.
    """
    shape = T.StructType([*T._parse_datatype_string(EVENT).fields, T.StructField("month", T.StringType())])
    months, at = [], start.replace(day=1)
    while (at.year, at.month) <= (end.year, end.month):
        months.append(f"{at:%Y-%m}")
        at = (at.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    found = spark.read.schema(shape).option("mode", "DROPMALFORMED").json(folder).where(F.col("month").isin(months))
    e = found.withColumn("at", F.try_to_timestamp("ts")).where(F.col("at").between(F.lit(start), F.lit(end)))
    if room is not None:
        e = e.where(F.col("room").isNull() | (F.col("room") == room) | F.coalesce(F.col("object_id").startswith(f"{room}/"), F.lit(False)))
    return e.drop("month")
