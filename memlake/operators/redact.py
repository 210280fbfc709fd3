"""Redaction and sentence segmentation of transcripts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import SECRET_PATTERNS
from memlake.operators.ingest import clip_bytes
from memlake.sources.transcripts import parse_transcript


def high_entropy(token: str) -> bool:
    """3.5 bits a character or more, or 32 hex digits; letters and digits both."""
    if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
        return False
    counts = Counter(c if c.isascii() else "wide" for c in token)
    bits = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    return bits >= 3.5 or re.fullmatch("[0-9a-fA-F]{32,}", token) is not None


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) in characters: leftmost first, longest of those that start together, no overlaps."""
    found = []
    for kind, pattern in SECRET_PATTERNS:
        for m in re.finditer(pattern, text):
            g = 1 if m.lastindex and kind in ("bearer_token", "key_value_secret") else 0
            if kind == "key_value_secret":
                g = m.lastindex
            if kind != "high_entropy" or high_entropy(m[0]):
                found.append((m.start(g), m.end(g), kind))
    out, end = [], 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], s[0] - s[1])):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def redact(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``text_col`` redacted, ``n_redacted`` and ``classes`` (distinct, sorted); null stays null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            spans = [secret_spans(t) if isinstance(t, str) else [] for t in pdf[text_col]]
            texts = []
            for t, found in zip(pdf[text_col], spans):
                for a, b, kind in reversed(found):
                    t = f"{t[:a]}[REDACTED:{kind}]{t[b:]}"
                texts.append(t)
            yield pdf.assign(**{text_col: texts, "n_redacted": [len(s) for s in spans], "classes": [",".join(sorted({k for _, _, k in s})) for s in spans]})

    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "n_redacted int", "classes string"])
    return docs.mapInPandas(run, shape)


def sentences_of(text: str, cap: int = 150) -> list[tuple[int, int, str, bool]]:
    """(start byte, end byte, sentence, opaque): fenced blocks are one opaque unit; prose is cut after . ! ?; pieces under three words join the one before."""
    out: list[tuple[int, int, bool]] = []
    at = 0
    for block in re.split(r"(```.*?(?:```|\Z))", text, flags=re.S):
        if block.startswith("```"):
            out.append((at, at + len(block), True))
        else:
            for m in re.finditer(r"[^\n.!?]*(?:[.!?]+(?=\s|\Z)|[.!?]+|\n|\Z)", block):
                raw = m[0]
                if not raw.strip():
                    continue
                a = at + m.start() + len(raw) - len(raw.lstrip())
                b = at + m.end() - (len(raw) - len(raw.rstrip()))
                if len(raw.split()) < 3 and out and not out[-1][2] and "\n" not in text[out[-1][1] : a]:
                    out[-1] = (out[-1][0], b, False)
                else:
                    out.append((a, b, False))
        at += len(block)
    size = lambda s: len(s.encode("utf-8"))
    return [(size(text[:a]), size(text[:b]), text[a:b], o) for a, b, o in out[:cap]]


def segment(records: DataFrame, keys: list[str], text_col: str, cap: int = 150) -> DataFrame:
    """One row per sentence: keys, ``sid`` (from 1), byte span, text and whether it is an opaque block; at most ``cap`` per record, as the format says."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(*k, i + 1, *s) for *k, t in pdf[[*keys, text_col]].itertuples(index=False, name=None) if isinstance(t, str) for i, s in enumerate(sentences_of(t, cap))]
            yield pd.DataFrame(rows, columns=[*keys, "sid", "start_byte", "end_byte", "sentence", "opaque"])

    kinds = dict(records.dtypes)
    shape = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "sid int, start_byte int, end_byte int, sentence string, opaque boolean"])
    return records.select(*keys, F.col(text_col).cast("string").alias(text_col)).mapInPandas(run, shape)


def transcript_sentences(lines: DataFrame, unit: str, position: str, value: str = "value", cap: int = 150) -> DataFrame:
    """V2: the citable sentences of transcript lines: parsed, redacted, cut, numbered through each unit and dealt into parts.

    ``lines`` has ``unit``, ``position`` (its order within the unit) and
    ``value``.  Returns unit, part (from 1), sid (from 1 in each part), position,
    role, start_byte, end_byte, sentence and opaque.  No sentence is dropped:
    those beyond ``cap`` open the next part.  A unit's sentences are ordered in
    one task; a unit is one session's turn.
    """
    told = parse_transcript(lines, value).where("status = 'text'").select(unit, position, "role", "text")
    cut = segment(redact(told, "text"), [unit, position, "role"], "text", cap=1 << 30)
    n = F.row_number().over(Window.partitionBy(unit).orderBy(position, "sid")) - 1
    return cut.withColumn("__n", n).select(
        unit, (F.floor(F.col("__n") / cap) + 1).cast("int").alias("part"), (F.col("__n") % cap + 1).alias("sid"), position, "role", "start_byte", "end_byte", "sentence", "opaque")


def rendered(sid: Column, role: Column, sentence: Column, opaque: Column, cap_bytes: int = 2048) -> Column:
    """The line that shows a sentence; an opaque block is cut at ``cap_bytes`` and its further lines are indented."""
    kept = clip_bytes(sentence, cap_bytes)
    lost = F.octet_length(sentence) - F.octet_length(kept)
    block = F.concat(F.replace(kept, F.lit("\n"), F.lit("\n  ")), F.when(lost > 0, F.concat(F.lit("… [+"), lost.cast("string"), F.lit(" bytes]"))).otherwise(""))
    return F.concat(F.lit("S"), sid.cast("string"), F.lit(" ["), role, F.lit("]: "), F.when(opaque, block).otherwise(sentence))


def render(sentences: DataFrame, keys: list[str], cap_bytes: int = 2048) -> DataFrame:
    """(keys, shown): the lines of each part of a unit, in order; a part has a bounded number of sentences."""
    line = rendered(F.col("sid"), F.col("role"), F.col("sentence"), F.col("opaque"), cap_bytes)
    listed = F.sort_array(F.collect_list(F.struct("sid", line.alias("line"))))
    return sentences.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("shown"))
