"""Transcripts as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_transcript(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``status`` (text, tool, skipped or blank), ``role`` and ``text`` to lines of a transcript.

    The role comes from the record's structure: its type, which the message's
    role must not contradict.  Text blocks are joined by a blank line; a record
    without text is ``tool`` if it holds tool blocks.  Malformed, meta and other
    records are skipped, and a null or blank line is ``blank``.
    """
    v = F.try_parse_json(F.col(value))
    at = lambda path, kind: F.try_variant_get(F.col("__v"), path, kind)
    out = lines.withColumn("__v", v).withColumns({
        "__type": at("$.type", "string"), "__role": at("$.message.role", "string"), "__meta": F.coalesce(at("$.isMeta", "boolean"), F.lit(False)),
        "__content": at("$.message.content", "variant"), "__result": at("$.toolUseResult", "variant").isNotNull()})
    kind = F.schema_of_variant("__content")
    blocks = F.when(kind.startswith("ARRAY"), at("$.message.content", "array<variant>"))
    of = lambda b, path: F.try_variant_get(b, path, "string")
    texts = F.when(kind == "STRING", F.array(at("$.message.content", "string"))).otherwise(
        F.transform(F.filter(blocks, lambda b: of(b, "$.type") == "text"), lambda b: of(b, "$.text")))
    out = out.withColumns({
        "__parts": F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t.isNotNull() & t.rlike(r"\S")),
        "__tool": F.coalesce(F.exists(blocks, lambda b: of(b, "$.type").isin("tool_use", "tool_result")), F.lit(False)) | F.col("__result")})
    ours = F.col("__type").isin("user", "assistant") & (F.col("__role").isNull() | (F.col("__role") == F.col("__type"))) & ~F.col("__meta") & F.coalesce((kind == "STRING") | kind.startswith("ARRAY"), F.lit(False))
    status = (F.when(F.col(value).isNull() | ~F.col(value).rlike(r"\S"), "blank").when(~F.coalesce(ours, F.lit(False)), "skipped")
              .when(F.size("__parts") > 0, "text").when(F.col("__tool"), "tool").otherwise("skipped"))
    shown = out.withColumn("status", status)
    told = F.col("status") == "text"
    return shown.select(*lines.columns, "status", F.when(told, F.col("__type")).alias("role"), F.when(told, F.array_join("__parts", "\n\n")).alias("text"))
