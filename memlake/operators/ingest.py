"""Note ingest: chunks, facts, preferences, entities, links and versions (S5, F3, F9-F12, J7, T-2, T-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as tx


def clip_bytes(text: Column, limit: int) -> Column:
    """the longest start of at most ``limit`` UTF-8 bytes that ends between characters."""
    raw = F.left(text, F.lit(limit))
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.aggregate(F.filter(F.split(raw, ""), lambda c: c != ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")),
                    lambda acc, c: F.struct(
                        F.when(acc["n"] + F.octet_length(c) <= limit, F.concat(acc["t"], c)).otherwise(acc["t"]).alias("t"),
                        # Once a character does not fit, none after it may.
                        F.when(acc["n"] + F.octet_length(c) <= limit, acc["n"] + F.octet_length(c)).otherwise(F.lit(limit)).alias("n")),
                    lambda acc: acc["t"]))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def chunk_notes(notes: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``(id, granularity, chunk_index, content, embed_text)``.

    One document chunk (2000 bytes), windows of two paragraphs (15 words or
    more, 1200 bytes) and of three sentences (6 words or more, 500 bytes), with
    one running index per note.  The title goes before the text to embed only.
    """
    c = F.coalesce(F.col(text_col), F.lit(""))
    base = notes.select(F.col(id_col).alias("id"), c.alias("c"), tx.extract_title(c).alias("title"))
    base = base.withColumn("body", F.when(F.col("c").rlike(r"(?m)^\s*# "), F.trim(F.regexp_replace("c", r"(?s)\A.*?(?:^|\n)[^\S\n]*# [^\n]*", ""))).otherwise(F.col("c")))
    paras = F.filter(F.transform(F.split("body", "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    sents = tx.split_sentences(F.col("body"))
    base = base.withColumns({"p": paras, "s": sents})
    para = F.filter(F.transform("p", lambda x, i: F.array_join(F.slice("p", i + 1, F.lit(2)), "\n\n")), lambda w: _words(w) >= 15)
    sent = F.filter(F.transform("s", lambda x, i: F.array_join(F.slice("s", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ")), lambda w: _words(w) >= 6)
    doc = F.filter(F.array(F.trim(clip_bytes(F.col("c"), 2000))), lambda d: d != "")
    made = F.concat(
        F.transform(doc, lambda t: F.struct(F.lit("document").alias("g"), t.alias("t"))),
        F.transform(para, lambda t: F.struct(F.lit("paragraph").alias("g"), clip_bytes(t, 1200).alias("t"))),
        F.transform(sent, lambda t: F.struct(F.lit("sentence").alias("g"), clip_bytes(t, 500).alias("t"))))
    out = base.select("id", "title", F.posexplode(made).alias("chunk_index", "x"))
    prefix = F.when(F.col("title") == "", "").otherwise(F.concat("title", F.lit(": ")))
    return out.select("id", F.col("x.g").alias("granularity"), "chunk_index", F.col("x.t").alias("content"), F.concat(prefix, F.col("x.t")).alias("embed_text"))


def _normalised(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"^(?:the|my|our|a|an)\s+", ""), r"\s+", " "))


def extract_facts(notes: DataFrame, id_col: str = "id", text_col: str = "content", cap: int = 8) -> DataFrame:
    """``(id, fact_no, subject, attribute, value, fact_id)``, at most ``cap`` per note, in text order."""
    sentence = notes.select(F.col(id_col).alias("id"), F.posexplode(tx.clause_sentences(F.col(text_col))).alias("pos", "s"))
    tries = F.array(*[
        F.struct(F.lit(i).alias("i"), _normalised(F.regexp_extract("s", p, 1)).alias("subject"),
                 F.trim(F.regexp_replace(_normalised(F.regexp_extract("s", p, 2)), r"[,:/]+$", "")).alias("value"))
        for i, p in enumerate(tx.FACT_PATTERNS)])
    found = sentence.select("id", "pos", F.explode(tries).alias("f")).select("id", "pos", "f.*")
    fits = F.octet_length("subject").between(3, 40) & F.octet_length("value").between(1, 40)
    first = Window.partitionBy("id", "subject", "value").orderBy("pos", "i")
    order = Window.partitionBy("id").orderBy("pos", "i")
    kept = found.where(fits).withColumn("r", F.row_number().over(first)).where("r = 1").withColumn("fact_no", F.row_number().over(order)).where(F.col("fact_no") <= cap)
    key = F.concat_ws("\u0000", "subject", F.lit(""), "value")
    return kept.select("id", "fact_no", "subject", F.lit("").alias("attribute"), "value", F.substring(F.sha2(key, 256), 1, 16).alias("fact_id"))


def extract_preferences(notes: DataFrame, id_col: str = "id", text_col: str = "content", cap: int = 6) -> DataFrame:
    """``(id, pref_no, sentence)``: sentences of 18 bytes or more with a marker, distinct by lower case."""
    sentence = notes.select(F.col(id_col).alias("id"), F.posexplode(tx.clause_sentences(F.col(text_col), ".!?")).alias("pos", "s"))
    marked = sentence.where((F.octet_length("s") >= 18) & F.lower("s").rlike("|".join(tx.PREFERENCE_MARKERS)))
    first = Window.partitionBy("id", F.lower("s")).orderBy("pos")
    order = Window.partitionBy("id").orderBy("pos")
    kept = marked.withColumn("r", F.row_number().over(first)).where("r = 1").withColumn("pref_no", F.row_number().over(order)).where(F.col("pref_no") <= cap)
    return kept.select("id", "pref_no", F.col("s").alias("sentence"))


#: Technology names that notes mention without markup.
TECHNOLOGIES = (
    "python javascript typescript rust golang java kotlin swift react vue angular svelte django flask fastapi spring node express "
    "postgresql mysql sqlite mongodb redis kafka spark hadoop airflow docker kubernetes terraform ansible aws azure gcp linux git github gitlab "
    "graphql grpc rest websocket pytorch tensorflow numpy pandas jupyter openai ollama onnx tauri electron vite webpack tailwind nginx").split()


def extract_entities(notes: DataFrame, id_col: str = "id", text_col: str = "content", cap: int = 30) -> DataFrame:
    """``(id, entity_no, name, entity_type)``: headings, wikilinks, code spans, technologies (by name), names, quotes; first wins, at most ``cap``."""
    c = F.col(text_col)

    def found(pattern: str, group: int, kind: str, order: int) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda x, i: F.struct(F.lit(order).alias("o"), i.alias("i"), F.trim(x).alias("name"), F.lit(kind).alias("entity_type")))

    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))
    tech = F.transform(F.array_sort(F.array_intersect(words, tx.strings(TECHNOLOGIES))), lambda x, i: F.struct(F.lit(3).alias("o"), i.alias("i"), x.alias("name"), F.lit("technology").alias("entity_type")))
    every = F.concat(found(r"(?m)^#{1,6}\s+(.+)$", 1, "concept", 0), found(r"\[\[([^\]|]+)", 1, "concept", 1), found(r"`([^`\n]+)`", 1, "technology", 2), tech,
                     found(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+){1,3})\b", 1, "person", 4), found(r"\"([^\"\n]{3,40})\"", 1, "concept", 5))
    flat = notes.select(F.col(id_col).alias("id"), F.explode(every).alias("e")).select("id", "e.*").where("name <> ''")
    first = Window.partitionBy("id", F.lower("name")).orderBy("o", "i")
    order = Window.partitionBy("id").orderBy("o", "i")
    kept = flat.withColumn("r", F.row_number().over(first)).where("r = 1").withColumn("entity_no", F.row_number().over(order)).where(F.col("entity_no") <= cap)
    return kept.select("id", "entity_no", "name", "entity_type")


def resolve_wikilinks(links: DataFrame, notes: DataFrame) -> DataFrame:
    """``target_id`` for (id, target): exact title, else the one note of that file base name, else of that title without its last parenthesis."""
    t = F.lower(F.trim("title"))
    base = F.lower(F.regexp_replace(F.element_at(F.split("filename", "/"), -1), r"\.md$", ""))
    bare = F.trim(F.regexp_replace(t, r"\s*\([^()]*\)\s*$", ""))
    exact = notes.groupBy(t.alias("target")).agg(F.min("id").alias("t1"))
    one = lambda key, name: notes.groupBy(key.alias("target")).agg(F.min("id").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    out = links.join(exact, "target", "left").join(one(base, "t2"), "target", "left").join(one(bare, "t3"), "target", "left")
    return out.withColumn("target_id", F.coalesce("t1", "t2", "t3")).drop("t1", "t2", "t3")


def upsert_plan(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What an ingest does with each incoming (filename, content): insert, skip, revive or update."""
    new = incoming.withColumn("new_hash", tx.content_hash(F.col("content"))).select("filename", "new_hash")
    return new.join(current.select("filename", "content_hash", "state"), "filename", "left").select(
        "filename", "new_hash",
        F.when(F.col("content_hash").isNull(), "insert").when((F.col("content_hash") == F.col("new_hash")) & (F.col("state") != "dormant"), "skip")
        .when(F.col("state") == "dormant", "revive").otherwise("update").alias("action"))


def mirror_plan(manifest: DataFrame, listing: DataFrame, root_reachable: bool = True) -> DataFrame:
    """S3: add, update, unchanged, duplicate or remove for (path, hash) of a mirrored folder; nothing goes while the root is out of reach."""
    same = Window.partitionBy("hash").orderBy("path")
    now = listing.withColumn("copy", F.row_number().over(same)).select("path", F.col("hash").alias("now"), "copy")
    both = manifest.select("path", F.col("hash").alias("was")).join(now, "path", "full_outer")
    action = (F.when(F.col("now").isNull(), "remove" if root_reachable else "unchanged").when(F.col("was") == F.col("now"), "unchanged")
              .when(F.col("copy") > 1, "duplicate").when(F.col("was").isNull(), "add").otherwise("update"))
    return both.select("path", action.alias("action"))


def current_facts(statements: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """T-2, A3: all distinct (keys, value) with ``is_current``: the newest statement wins, so A, B, A ends with A."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    ranked = statements.withColumn("__r", F.row_number().over(newest))
    return ranked.groupBy(*keys, value).agg(F.min("__r").alias("__r"), F.count(F.lit(1)).alias("statements")).withColumn("is_current", F.col("__r") == 1).drop("__r")


def versions(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """T-7: version numbers; a row that repeats the value before it makes no version."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = rows.withColumn("__p", F.lag(value).over(w)).where(F.col("__p").isNull() | ~F.col(value).eqNullSafe(F.col("__p"))).drop("__p")
    return changed.withColumn("version", F.row_number().over(w))
