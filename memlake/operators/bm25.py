"""Keyword retrieval over a stored, term-partitioned index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import tokenize
from memlake.plans.shared import SharedStage
from memlake.plans.spread import spread_small


class KeywordIndex:
    """Postings by term in a folder: ``(term, id, tf, doc_len)``, in files by bucket of the term, sorted by term.

    A reader of some terms opens their buckets only, and Parquet's statistics
    skip what else is not theirs.  An update is an epoch of its own: postings of
    the documents that changed, and the ids whose earlier postings no longer
    count; readers merge epochs, ``compact`` writes them as one.  An epoch is
    there once its document table, written last, is whole; writing it again
    replaces it, so an update that is tried again does no harm.  Documents
    without tokens have no postings.  A bucket is written by ``SPREAD`` tasks, so
    a term of very many documents is not one task's work.
    """

    SPREAD = 4

    def __init__(self, spark: SparkSession, root: str, epochs: int, buckets: int):
        self.spark, self.root, self.epochs, self.buckets = spark, root, epochs, buckets

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 32, root: str | None = None) -> KeywordIndex:
        """A new index of all documents, in ``root`` or a fresh folder of the shared one."""
        spark = docs.sparkSession
        out = cls(spark, root or SharedStage(spark, "keywords").path("index"), 1, buckets)
        out._write(0, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None)
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str, buckets: int = 32) -> KeywordIndex:
        """The index in a folder, with its whole epochs; ``buckets`` as it was built."""
        epochs = 0
        while _exists(spark, f"{root}/docs/epoch={epochs}/_SUCCESS"):
            epochs += 1
        if not epochs:
            raise ValueError(f"no keyword index in {root}")
        return cls(spark, root, epochs, buckets)

    def stands(self) -> bool:
        """Whether the index is still in its folder."""
        return _exists(self.spark, f"{self.root}/docs/epoch={self.epochs - 1}/_SUCCESS")

    def _bucket(self, term: str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, epoch: int, docs: DataFrame, gone: DataFrame | None) -> None:
        tokens = spread_small(docs).select("id", tokenize(F.col("text")).alias("terms")).where(F.size("terms") > 0).select("id", F.size("terms").alias("doc_len"), "terms")
        each = tokens.select("id", "doc_len", F.explode("terms").alias("term")).withColumns({"bucket": self._bucket(), "share": F.pmod(F.xxhash64("id"), F.lit(self.SPREAD))})
        counted = each.repartition("bucket", "share").groupBy("bucket", "share", "term", "id", "doc_len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        sorted_ = counted.select("term", "id", "tf", "doc_len", "bucket").sortWithinPartitions("bucket", "term", "id")
        sorted_.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/epoch={epoch}")
        if gone is not None:
            gone.write.mode("overwrite").parquet(f"{self.root}/gone/epoch={epoch}")
        written = self.spark.read.schema("id " + docs.schema["id"].dataType.simpleString() + ", doc_len int").parquet(f"{self.root}/postings/epoch={epoch}")
        written.select("id", "doc_len").distinct().write.mode("overwrite").parquet(f"{self.root}/docs/epoch={epoch}")

    def update(self, changed: DataFrame, deleted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> KeywordIndex:
        """The index with the texts of ``changed`` (new or edited) and without the ids of ``deleted``; writes their postings only."""
        docs = changed.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        gone = docs.select("id")
        if deleted is not None:
            gone = gone.unionByName(deleted.select(F.col(id_col).alias("id")))
        self._write(self.epochs, docs, gone.where("id IS NOT NULL").distinct())
        return KeywordIndex(self.spark, self.root, self.epochs + 1, self.buckets)

    def compact(self, root: str | None = None) -> KeywordIndex:
        """All epochs as one, in a new folder."""
        out = KeywordIndex(self.spark, root or SharedStage(self.spark, "keywords").path("index"), 1, self.buckets)
        placed = self.postings().withColumns({"bucket": self._bucket(), "share": F.pmod(F.xxhash64("id"), F.lit(self.SPREAD))}).repartition("bucket", "share").drop("share")
        placed.sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{out.root}/postings/epoch=0")
        self.docs().write.mode("overwrite").parquet(f"{out.root}/docs/epoch=0")
        return out

    def _live(self, kind: str) -> DataFrame:
        """The rows of a table of all epochs that no later epoch replaces; ``epoch`` is a column of it."""
        paths = [f"{self.root}/{kind}/epoch={e}" for e in range(self.epochs)]
        if self.epochs == 1:
            return self.spark.read.parquet(paths[0])
        rows = self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*paths)
        gone = self.spark.read.option("basePath", f"{self.root}/gone").parquet(*[f"{self.root}/gone/epoch={e}" for e in range(1, self.epochs)])
        last = gone.groupBy(F.col("id").alias("gone_id")).agg(F.max("epoch").alias("since"))
        return rows.join(last, (F.col("id") == F.col("gone_id")) & (F.col("epoch") < F.col("since")), "left_anti").drop("epoch")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``(term, id, tf, doc_len)``, of the given ``term`` values only, or of all."""
        rows = self._live("postings")
        if terms is not None:
            wanted = terms.select("term").distinct().withColumn("wanted", self._bucket())
            buckets = sorted(r[0] for r in wanted.select("wanted").distinct().collect())  # `buckets` numbers at most
            rows = rows.where(F.col("bucket").isin(buckets)).join(wanted, (F.col("bucket") == F.col("wanted")) & (rows["term"] == wanted["term"]), "left_semi")
        return rows.select("term", "id", "tf", "doc_len")

    def docs(self) -> DataFrame:
        """``(id, doc_len)`` of the documents with tokens."""
        return self._live("docs").select("id", "doc_len")

    def stats(self) -> DataFrame:
        """One row: number of documents and their mean length."""
        return self.docs().agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def okapi_idf(n: Column, df: Column) -> Column:
    """ln((N - df + .5) / (df + .5)); a quarter of it where negative."""
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw < 0, raw * 0.25).otherwise(raw)


def bm25(
    queries: DataFrame, index: KeywordIndex, k: int, query_id: str = "query_id", query_text: str = "q", k1: float = 1.5, b: float = 0.75, probe: int = 20, prune_from: int = 1 << 25,
) -> DataFrame:
    """``(query_id, id, score, rank)``: the top ``k`` of each query above a tenth of its best score; ties go by the id.

    A repeated query term counts each time.  Exact, without scoring every
    document that shares a common word: the rarest terms of a query, until
    ``probe`` * k postings, give at least the scores that its best documents
    have.  The strongest postings of its weakest terms, summed, show which terms
    cannot lift a document to that alone.  Only documents with one of the other
    terms are candidates, and the weak terms' postings count for those only.
    """
    stage = SharedStage(queries.sparkSession, "bm25")
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    hits = stage.put(index.postings(terms), "hits")
    whole = index.stats().first()
    n, avgdl = F.lit(float(whole["n_docs"])), F.lit(whole["avgdl"] or 1.0)
    factor = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))
    held = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("most_tf"), F.min("doc_len").alias("least_len"))
    weight = okapi_idf(n, F.col("df")) * F.col("qtf")
    weighted = terms.join(held, "term").select("query_id", "term", "df", weight.alias("weight"), (F.greatest(weight, F.lit(0.0)) * factor(F.col("most_tf"), F.col("least_len"))).alias("most"))
    weighted = stage.put(weighted, "weights")
    part = F.col("weight") * factor(F.col("tf"), F.col("doc_len"))
    every = weighted.agg(F.sum("df")).first()[0] or 0
    told, spared = weighted.withColumn("idle", F.lit(False)), 0
    if every >= prune_from:
        # What the best documents have at least: rare terms' parts, and all that negative weights could take off.
        rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)  # a query's terms
        first = weighted.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("before") < probe * k)
        losses = weighted.groupBy("query_id").agg(F.sum(F.least("weight", F.lit(0.0)) * (k1 + 1)).alias("loss"))
        lower = hits.join(first.select("query_id", "term", "weight"), "term").groupBy("query_id", "id").agg(F.sum(part).alias("s"))
        down = Window.partitionBy("query_id").orderBy(F.col("s").desc())
        best = lower.withColumn("place", F.row_number().over(down)).where(F.col("place") <= k).groupBy("query_id").agg(F.max("s").alias("top"), F.min(F.when(F.col("place") == k, F.col("s"))).alias("last"))
        bar = best.join(losses, "query_id").select("query_id", F.greatest(F.col("last") + F.col("loss"), 0.1 * (F.col("top") + F.col("loss"))).alias("bar"))
        weak = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        told = weighted.withColumn("reach", F.sum("most").over(weak)).join(bar, "query_id", "left")
        told = stage.put(told.select("query_id", "term", "df", "weight", F.coalesce((F.col("bar") > 0) & (F.col("reach") < F.col("bar") * (1 - 1e-9)), F.lit(False)).alias("idle")), "told")
        spared = told.agg(F.sum(F.when(F.col("idle"), F.col("df")))).first()[0] or 0
    scored = hits.join(told, "term").select("query_id", "id", "idle", part.alias("part"))
    if spared and 2 * spared >= every:
        found = stage.put(scored.where("NOT idle").groupBy("query_id", "id").agg(F.sum("part").alias("part")), "found")
        scored = found.unionByName(scored.where("idle").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", "part"))
    score = scored.groupBy("query_id", "id").agg(F.sum("part").alias("score")).where("score <> 0")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    ranked = score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    top = F.max("score").over(Window.partitionBy("query_id"))  # k rows
    return ranked.withColumn("best", top).where((F.col("best") <= 0) | (F.col("score") > 0.1 * F.col("best"))).select("query_id", "id", "score", "rank")


def query_signal(queries: DataFrame, index: KeywordIndex, query_id: str = "query_id", query_text: str = "q") -> DataFrame:
    """Per query token its document frequency and idf (with + 1 inside the log), and the query's best idf."""
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokenize(F.col(query_text)))).alias("term"))
    df = index.postings(terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(float(index.stats().first()["n_docs"]))
    out = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    out = out.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    return out.withColumn("max_idf", F.max("idf").over(Window.partitionBy("query_id")))
