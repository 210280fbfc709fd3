"""The write path: batches, retries at every point, edited files of a folder."""

import os
import time

import pytest
from pyspark.sql import functions as F

from memlake.operators.store import TABLES, NoteStore, folder_changes, next_manifest
from memlake.plans.shared import SharedStage

BATCH = "filename string, content string, removed boolean, changed_at timestamp"


def _batch(spark, rows):
    return spark.createDataFrame(rows, "filename string, content string, removed boolean, at string").withColumn("at", F.col("at").cast("timestamp")).withColumnRenamed("at", "changed_at")


def _all(store):
    return {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in TABLES}


ONE = [("a.md", "# Alpha\n\nOur database is now postgres. It links [[beta|uses]] and [[gamma]].", False, "2024-01-01"), ("b.md", "# Beta\n\nplain", False, "2024-01-01"), ("c.md", None, False, "2024-01-01"),
       (None, "lost", False, "2024-01-01"), ("b.md", "older", False, "2023-01-01")]
TWO = [("a.md", "# Alpha\n\nOur database is now sqlite. It links [[beta]].", False, "2024-01-02"), ("b.md", "# Beta\n\nplain", False, "2024-01-02"), ("c.md", None, True, "2024-01-02"), ("never.md", None, True, "2024-01-02")]
THREE = [("a.md", None, True, "2024-01-03"), ("c.md", None, False, "2024-01-03"), ("d.md", "new", False, "2024-01-03")]
FOUR = [("a.md", "# Alpha\n\nback with other text", False, "2024-01-04")]


def test_batches(spark):
    store = NoteStore(spark, SharedStage(spark, "t").path("s"), buckets=3)
    for i, rows in enumerate([ONE, TWO, THREE, FOUR]):
        store.apply(_batch(spark, rows), i)
    notes = {r.filename: r for r in store.read("notes").collect()}
    assert {f: r.state for f, r in notes.items()} == {"a.md": "fresh", "b.md": "fresh", "c.md": "fresh", "d.md": "fresh"}
    assert notes["a.md"].content.endswith("other text") and str(notes["a.md"].created_at) == "2024-01-01 00:00:00" and str(notes["b.md"].updated_at) == "2024-01-01 00:00:00"
    past = sorted((r.version, r.content) for r in store.read("versions").where(F.col("id") == notes["a.md"].id).collect())
    assert past == [(1, ONE[0][1]), (2, TWO[0][1])]
    assert store.read("links").count() == 0 and {r.content for r in store.read("chunks").where(F.col("id") == notes["a.md"].id).where("granularity = 'document'").collect()} == {"# Alpha\n\nback with other text"}
    with pytest.raises(AttributeError):
        notes["a.md"].never


def test_removed_notes_lose_what_derives_from_them(spark):
    store = NoteStore(spark, SharedStage(spark, "t").path("s"), buckets=3)
    store.apply(_batch(spark, ONE), 0)
    a = store.read("notes").where("filename = 'a.md'").first().id
    assert {(r.target, r.link_type) for r in store.read("links").collect()} == {("beta", "uses"), ("gamma", None)} and store.read("facts").where(F.col("id") == a).count() == 1
    store.apply(_batch(spark, [("a.md", None, True, "2024-02-01")]), 1)
    assert store.read("notes").where("filename = 'a.md'").first().state == "dormant"
    assert all(store.read(t).where(F.col("id") == a).count() == 0 for t in ("chunks", "links", "entities", "facts"))


@pytest.mark.parametrize("cut", ["staging", "publishing", "done"])
def test_a_batch_cut_off_anywhere_is_applied_once(spark, cut, monkeypatch):
    plain = NoteStore(spark, SharedStage(spark, "t").path("s"), buckets=3)
    for i, rows in enumerate([ONE, TWO]):
        plain.apply(_batch(spark, rows), i)
    store = NoteStore(spark, SharedStage(spark, "t").path("s"), buckets=3)
    store.apply(_batch(spark, ONE), 0)
    calls = {"n": 0}

    def fail(real, at):
        def run(*args):
            calls["n"] += 1
            if calls["n"] == at:
                raise RuntimeError("lost")
            return real(*args)

        return run

    with monkeypatch.context() as m:
        if cut == "staging":
            m.setattr(NoteStore, "read", fail(NoteStore.read, 3))
        elif cut == "publishing":
            m.setattr(NoteStore, "_folder", fail(NoteStore._folder, len(TABLES) + 3))
        else:
            m.setattr(NoteStore, "_mark", fail(NoteStore._mark, 2))
        with pytest.raises(RuntimeError):
            store.apply(_batch(spark, TWO), 1)
    store.apply(_batch(spark, TWO), 1)
    store.apply(_batch(spark, TWO), 1)
    assert _all(store) == _all(plain)


def test_edited_files_of_a_folder_are_taken(spark, tmp_path):
    store, folder = NoteStore(spark, SharedStage(spark, "t").path("s"), buckets=2), f"file://{tmp_path}"
    manifest = spark.createDataFrame([], "filename string, changed_at timestamp, bytes long")

    def sync(batch):
        nonlocal manifest
        changes = SharedStage(spark, "t").put(folder_changes(spark, folder, manifest), "changes")
        store.apply(changes, batch)
        manifest = SharedStage(spark, "t").put(next_manifest(manifest, changes), "manifest")
        return sorted((r.filename, r.content, r.removed) for r in changes.collect())

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("first")
    (tmp_path / "sub" / "b c.md").write_text("second")
    assert sync(0) == [("a.md", "first", False), ("sub/b c.md", "second", False)]
    assert sync(1) == []
    (tmp_path / "a.md").write_text("first, edited")
    os.utime(tmp_path / "a.md", (time.time() - 9000, time.time() - 9000))  # an earlier time than before
    assert sync(2) == [("a.md", "first, edited", False)]
    (tmp_path / "sub" / "b c.md").unlink()
    assert sync(3) == [("sub/b c.md", None, True)]
    assert {(r.filename, r.content, r.state) for r in store.read("notes").collect()} == {("a.md", "first, edited", "fresh"), ("sub/b c.md", "second", "dormant")}


def test_a_stream_feeds_the_store(spark, tmp_path):
    store = NoteStore(spark, SharedStage(spark, "t").path("s"), buckets=2)
    for i, rows in enumerate([ONE, TWO]):
        _batch(spark, rows).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        run = spark.readStream.schema(BATCH).parquet(f"file://{tmp_path}/in").writeStream.foreachBatch(store.apply).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        run.awaitTermination()
    assert {r.filename: r.state for r in store.read("notes").collect()} == {"a.md": "fresh", "b.md": "fresh", "c.md": "dormant"}
