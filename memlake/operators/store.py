"""The write path of notes (S4, S5, S13, T-7): batches of changed files merged into stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators.ingest import chunk_notes, extract_entities, extract_facts

NOTE = "id string, filename string, title string, kind string, content string, content_hash string, state string, created_at timestamp, updated_at timestamp"
#: The tables of a store; each has a column ``bucket`` besides, which its files are parted by.
TABLES = {
    "notes": NOTE,
    "versions": "id string, version int, content string, content_hash string, replaced_at timestamp",
    "chunks": "id string, granularity string, chunk_index int, content string, embed_text string",
    "links": "id string, target string, link_type string",
    "entities": "id string, entity_no int, name string, entity_type string",
    "facts": "id string, fact_no int, subject string, attribute string, value string, fact_id string",
}
DERIVED = ("chunks", "links", "entities", "facts")


class NoteStore:
    """Notes and all that derives from them, in a folder that executors share.

    ``apply`` merges one batch.  It reads the buckets of the batch's files only,
    writes their new rows of all tables beside the store, marks them as staged,
    and then overwrites these buckets, one partition each.  A batch is known by
    its id: one that ended is passed over, one that was cut off while staging is
    worked out again from unchanged tables, one that was cut off later is
    published again as staged.  So a retry changes nothing, whatever it repeats;
    batches must come one after the other, as a stream's do.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """A table with its bucket, or some buckets of it."""
        rows = self.spark.read.schema(f"{TABLES[table]}, bucket int").parquet(self._folder(table))
        return rows if only is None else rows.where(F.col("bucket").isin(only))

    def _folder(self, table: str) -> str:
        at = self._path(f"{self.root}/tables/{table}")
        self._fs(at).mkdirs(at)
        return str(at)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _there(self, name: str) -> bool:
        return self._fs(self._path(name)).exists(self._path(name))

    def _mark(self, name: str) -> None:
        self._fs(self._path(name)).create(self._path(name), True).close()

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge ``(filename, content, removed, changed_at)``; usable as the function of ``foreachBatch``.

        Of several rows of a file the last counts (by time, then text).  A file
        whose text has the stored hash is skipped, unless its note is dormant: it
        then comes back.  A changed text leaves its former one as a version and
        has its chunks, links, entities and facts made anew.  A removed file's
        note becomes dormant and loses them.  A null text is empty; rows without
        a file name are left out.
        """
        home = f"{self.root}/batches/{int(batch_id)}"
        if self._there(f"{home}/done"):
            return
        if not self._there(f"{home}/staged"):
            self._stage(batch, home)
            self._mark(f"{home}/staged")
        touched = [r.bucket for r in self.spark.read.parquet(f"{home}/buckets").collect()]  # `buckets` numbers at most
        for table in TABLES:
            rows = self.spark.read.schema(f"{TABLES[table]}, bucket int").parquet(f"{home}/{table}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._folder(table))
            for bucket in touched:  # a bucket that lost its last row
                if not self._there(f"{home}/{table}/bucket={bucket}"):
                    at = self._path(f"{self.root}/tables/{table}/bucket={bucket}")
                    self._fs(at).delete(at, True)
        self._mark(f"{home}/done")
        for table in (*TABLES, "incoming", "merged"):
            at = self._path(f"{home}/{table}")
            self._fs(at).delete(at, True)

    def _stage(self, batch: DataFrame, home: str) -> None:
        put = lambda df, name, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{home}/{name}")
        newest = Window.partitionBy("filename").orderBy(F.col("changed_at").desc_nulls_last(), F.col("content").desc_nulls_last())
        last = batch.where("filename IS NOT NULL").withColumn("place", F.row_number().over(newest)).where("place = 1")
        text = F.coalesce("content", F.lit(""))
        put(last.select(
            note_id(F.col("filename")).alias("id"), "filename", text.alias("text"), tx.content_hash(text).alias("new_hash"), F.coalesce("removed", F.lit(False)).alias("removed"),
            "changed_at", self._bucket().alias("bucket")), "incoming")
        incoming = self.spark.read.parquet(f"{home}/incoming")
        put(incoming.select("bucket").distinct(), "buckets")
        touched = [r.bucket for r in self.spark.read.parquet(f"{home}/buckets").collect()]
        was = self.read("notes", touched)
        new = incoming.select("id", F.col("filename").alias("new_name"), "text", "new_hash", "removed", "changed_at", F.col("bucket").alias("new_bucket"))
        both = was.join(new, "id", "full_outer")
        old, same = F.col("filename").isNotNull(), F.col("content_hash") == F.col("new_hash")
        action = (
            F.when(F.col("new_name").isNull(), "keep").when(F.col("removed"), F.when(old & (F.col("state") != "dormant"), "drop").when(old, "keep").otherwise("none"))
            .when(~old, "insert").when(F.col("state") == "dormant", F.when(same, "revive").otherwise("change")).when(same, "keep").otherwise("change"))
        put(both.withColumn("action", action).where("action <> 'none'").withColumn("bucket", F.coalesce("bucket", "new_bucket")), "merged", "bucket")
        merged = self.spark.read.schema(f"{NOTE}, new_name string, text string, new_hash string, removed boolean, changed_at timestamp, action string, bucket int").parquet(f"{home}/merged")
        written = F.col("action").isin("insert", "change")
        title = F.coalesce(F.nullif(tx.extract_title(F.col("text")), F.lit("")), F.regexp_replace("new_name", r"^.*/|\.md$", ""))
        pick = lambda new, old: F.when(written, new).otherwise(F.col(old)).alias(old)
        state = F.when(F.col("action") == "drop", "dormant").when(F.col("action").isin("insert", "change", "revive"), "fresh").otherwise(F.col("state"))
        put(merged.select(
            "id", F.coalesce("filename", "new_name").alias("filename"), pick(title, "title"), pick(tx.infer_kind(F.col("new_name")), "kind"), pick(F.col("text"), "content"),
            pick(F.col("new_hash"), "content_hash"), state.alias("state"), F.coalesce("created_at", "changed_at").alias("created_at"),
            F.when(F.col("action") == "keep", F.col("updated_at")).otherwise(F.col("changed_at")).alias("updated_at"), "bucket"), "notes", "bucket")
        kept = self.read("versions", touched)
        have = kept.groupBy("id").agg(F.max("version").alias("last"))
        past = merged.where("action = 'change'").join(have, "id", "left").select(
            "id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "content", "content_hash", F.col("changed_at").alias("replaced_at"), "bucket")
        put(kept.unionByName(past), "versions", "bucket")
        # Derived rows: those of notes that this batch leaves alone stay, those of written or revived ones are made anew.
        stay = merged.where("action = 'keep'").select("id")
        made = merged.where("action IN ('insert', 'change', 'revive')").select("id", "text", "bucket")
        buckets = made.select("id", "bucket")
        links = made.select("id", F.explode(tx.typed_wikilinks(F.col("text"))).alias("l")).select("id", "l.*").distinct()
        fresh = {"chunks": chunk_notes(made, text_col="text"), "links": links, "entities": extract_entities(made, text_col="text"), "facts": extract_facts(made, text_col="text")}
        for table in DERIVED:
            rows = self.read(table, touched).join(stay, "id", "left_semi").unionByName(fresh[table].join(buckets, "id"), allowMissingColumns=True)
            put(rows.select(*[f.split()[0] for f in TABLES[table].split(", ")], "bucket"), table, "bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("filename"), F.lit(self.buckets)).cast("int")


def note_id(filename: Column) -> Column:
    """A note's id: known by its file, so that any run gives it the same."""
    return F.substring(F.sha2(filename, 256), 1, 24)


def folder_changes(spark: SparkSession, folder: str, manifest: DataFrame, pattern: str = "*.md") -> DataFrame:
    """``(filename, content, removed, changed_at, bytes)`` of files that are new, edited or gone since ``manifest`` (filename, changed_at, bytes).

    A listing is compared, so an edit of a known file counts, as does one that
    sets an earlier time.  Only files at least as new as the oldest changed one
    are opened.
    """
    root = folder.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    named = lambda path: F.substring_index(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), root, -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    now = files.select(named(F.col("path")).alias("filename"), F.col("modificationTime").alias("changed_at"), F.col("length").alias("bytes"))
    changed = now.join(manifest.select("filename", "changed_at", "bytes"), ["filename", "changed_at", "bytes"], "left_anti")
    oldest = changed.agg(F.min("changed_at")).first()[0]
    gone = manifest.select("filename", F.col("changed_at").alias("was")).join(now.select("filename"), "filename", "left_anti").select(
        "filename", F.lit(None).cast("string").alias("content"), F.lit(True).alias("removed"), F.current_timestamp().alias("changed_at"), F.lit(0).cast("long").alias("bytes"))
    if oldest is None:
        return gone
    text = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select("value", named(F.col("_metadata.file_path")).alias("filename"), F.col("_metadata.file_modification_time").alias("at"))
    read = changed.join(text.where(F.col("at") >= F.lit(oldest)).select("filename", F.col("value").alias("content")), "filename", "left")
    return read.select("filename", "content", F.lit(False).alias("removed"), "changed_at", "bytes").unionByName(gone)


def next_manifest(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest after ``changes``."""
    now = changes.where("NOT removed").select("filename", "changed_at", "bytes")
    return manifest.select("filename", "changed_at", "bytes").join(changes.select("filename"), "filename", "left_anti").unionByName(now)
