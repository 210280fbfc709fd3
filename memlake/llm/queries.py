"""Registered queries of the numbered operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.decontaminate import contaminated_passages
from memlake.llm.exact_dedup import exact_duplicates
from memlake.llm.filter_audit import audit_filters
from memlake.llm.html_extract import main_text
from memlake.llm.langid import fit, identify
from memlake.llm.license_scan import scan_licenses
from memlake.llm.line_dedup import drop_recurring_lines
from memlake.llm.mixing import mix_sources
from memlake.llm.near_dedup import near_duplicates
from memlake.llm.sharding import shard_rows
from memlake.llm.stages import run
from memlake.llm.token_count import token_counts
from memlake.llm.token_store import read_token_store, write_token_store
from memlake.llm.vector_codes import vector_codes
from memlake.plans.shared import SharedStage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents through counting quotient filters."""
    return exact_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 8 shards, row counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return contaminated_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix of sources."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(rows, ["doc_id"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; documents with remainder 2 are held out of the fit."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit(docs.where(~F.coalesce(held, F.lit(False))))
    return identify(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to a store and read back."""
    import public_tokenizers

    path = SharedStage(spark, "tokens").path("store")
    write_token_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    back = read_token_store(spark, path)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license wording that a document holds."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SuperMinHash near-dedup of all documents, 4-word shingles, 80 per cent."""
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose template recurs."""
    return drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document by a compiled transducer."""
    import public_tokenizers

    found = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in every order."""
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT doc_id, t, part, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS failed
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a),
o AS (
  SELECT p.a || q.a || r.a || s.a || t.a AS filter_order FROM x p, x q, x r, x s, x t
  WHERE p.a <> q.a AND r.a NOT IN (p.a, q.a) AND s.a NOT IN (p.a, q.a, r.a) AND t.a NOT IN (p.a, q.a, r.a, s.a)),
st AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
         coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda y: CASE WHEN y = '' THEN 0 ELSE 1 << (ascii(y) - 65) END)), 0) AS prior
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (
  SELECT part, filter_order, step, own,
         count(*) FILTER (failed & (prior::INT | own) = 0) AS kept, count(*) FILTER (failed & prior::INT = 0 AND failed & own <> 0) AS removed,
         count(*) FILTER (failed & prior::INT <> 0 AND failed & own <> 0) AS redundant, count(*) FILTER (failed = own) AS unique_fails,
         count(*) FILTER (failed & prior::INT = 0 AND failed & own <> 0 AND good) AS good_lost, count(*) FILTER (failed & prior::INT = 0 AND failed & own <> 0 AND bad) AS toxic_lost
  FROM f, st GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four parts for every vector, 256 entries each, trained in four rounds."""
    return vector_codes(_table(spark, sf_dir, "embeddings"))


_ASSIGN = """
a{i} AS MATERIALIZED (
  SELECT rn, p.part, min(CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) * 256 + entry) AS best
  FROM p JOIN c{i} ON p.part = c{i}.part GROUP BY rn, p.part)"""
_MOVE = """
m{j} AS (
  SELECT part, entry, list(x ORDER BY pos) AS moved
  FROM (SELECT part, entry, pos, floor(sum(x) / count(*)) AS x
        FROM (SELECT part, best % 256 AS entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{i} JOIN p USING (rn, part)) GROUP BY part, entry, pos)
  GROUP BY part, entry),
c{j} AS MATERIALIZED (SELECT c{i}.part, c{i}.entry, coalesce(moved, c) AS c FROM c{i} LEFT JOIN m{j} ON c{i}.part = m{j}.part AND c{i}.entry = m{j}.entry)"""
OP13_SQL = """
WITH k AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS rn, len(embedding) // 4 AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, part, list_transform(embedding[part * n + 1:part * n + n], lambda x: floor(1024 * x::DOUBLE)) AS v FROM k, range(4) AS r(part)),
c0 AS MATERIALIZED (SELECT part, rn AS entry, v AS c FROM p WHERE rn < 256),
""" + ",".join(_ASSIGN.format(i=i) + "," + _MOVE.format(i=i, j=i + 1) for i in range(4)) + "," + _ASSIGN.format(i=4) + """,
b AS (SELECT sha256(string_agg(array_to_string(CAST(c AS BIGINT[]), ','), ',' ORDER BY part, entry)) AS h FROM c4),
f AS (SELECT rn, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM k JOIN f USING (rn), b
"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_text": op2_html_text,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_token_store": op7_token_store,
    "op8_license_scan": op8_license_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": run,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op12_filter_audit": OP12_SQL, "op13_vector_codes": OP13_SQL}
