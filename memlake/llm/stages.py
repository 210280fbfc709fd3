"""The stages of the corpus pipeline: five operators over the table of documents.

Each stage takes (spark, docs, sf_dir); it is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents, in
their order; extra columns pass through, and no helper column takes the name of
one of them.  A row is known by its ``doc_id`` and its text, since ids may be
null or repeated.  Every stage turns an empty table into an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.decontaminate import decontaminate
from memlake.llm.langid import fit, identify
from memlake.llm.mixing import mix_sources
from memlake.llm.near_dedup import near_duplicates
from memlake.llm.sharding import shard_rows
from memlake.plans.names import free_names
from memlake.plans.shared import SharedStage

#: Language ID rejects a text without letters, or one where no language has this share of the letters.
LEAST_LANGUAGE_SHARE = 0.2
#: The target mix: a source of n rows weighs n ** MIX_POWER.
MIX_POWER = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language; a missing ``lang`` is filled in with the one found.

    Null, empty and letterless texts go.  Repeated rows are judged alike, so all
    stay or all go; null ids are ids as any other.
    """
    lang, share = free_names(docs, "__lang", "__share")
    found = identify(docs, fit(docs), pred_col=lang, score_col=share)
    kept = found.where((F.col(lang) != "und") & (F.col(share) >= LEAST_LANGUAGE_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (5-word shingles, 0.8): the one of the least (doc_id, text hash).

    Null ids come last.  Rows that share an id have links by their own texts.
    Of rows equal in id and text one stays, the least by its other columns.
    Texts without words have no copies: all their rows stay.
    """
    found = near_duplicates(docs, shingle=5, percent=80, mark_rows=True).where("n_shingles > 0")
    told = SharedStage(spark, "pipeline").put(
        found.groupBy(F.col("id").alias("told_id"), F.col("row_hash").alias("told_hash")).agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("copies"))
        .where("NOT stays OR copies > 1"), "told")
    row_hash, all_columns = free_names(docs, "__row_hash", "__all")
    keyed = docs.withColumn(row_hash, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col(row_hash) == F.col("told_hash"))
    out = keyed.join(told.select("told_id", "told_hash"), same, "left_anti").select(*docs.columns)
    repeated = told.where("stays AND copies > 1")
    if repeated.isEmpty():
        return out
    one = keyed.join(repeated.select("told_id", "told_hash"), same, "left_semi").groupBy("doc_id", row_hash).agg(F.min(F.struct(*docs.columns)).alias(all_columns))
    return out.unionByName(one.select(f"{all_columns}.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold none.  Repeated rows are judged alike; null ids
    are ids as any other.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the mix of sources takes while nearly all sources last (see ``mix_sources``).

    A null source is a source of its own; texts are not looked at but for a hash
    that settles the order of rows that share an id.  Rows equal in id and text
    may swap places, each counts.
    """
    (row_hash,) = free_names(docs, "__row_hash")
    keyed = docs.withColumn(row_hash, F.xxhash64(F.col("text").cast("string")))
    return mix_sources(keyed, ["doc_id", row_hash], power=MIX_POWER).where("in_mix").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents into 8 shards of equal row counts, in uniformly shuffled order.

    Adds ``shard`` and ``slot`` (replaced if there).  Null ids, null texts and
    repeated rows count as any other row; rows equal in id and text may swap
    places.
    """
    (row_hash,) = free_names(docs, "__row_hash")
    keyed = docs.withColumn(row_hash, F.xxhash64(F.col("text").cast("string")))
    return shard_rows(keyed, ["doc_id", row_hash]).drop(row_hash)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    stage = SharedStage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        kept = stage.put(step(spark, docs, sf_dir), name)
        stage.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
