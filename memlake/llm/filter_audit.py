"""How filters act on each other, in every order (operator 12).

A relational word pipeline: texts explode to words, (document, word) counts
them, the document then has its total and its distinct words.  An outer join
puts them beside the flags that need no words.  Each document so fails some set
of the filters; a conditional count per set and part (32 columns for five
filters) is all that the orders need: what a step removes is a sum over sets.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the text filters: white space, the signs of D.
SPACE = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"


def word_totals(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(*keys, n_rows, words, distinct_words)`` of each document of ``texts``, known by ``keys`` (words: runs without ASCII white space).

    Rows that repeat their keys hold the same text: they count in ``n_rows``,
    and both other numbers are those of one of them.  Texts are dealt out by the
    keys once, so both aggregations find their rows together and no word is
    shuffled: a text takes half the room of its counted words.
    """
    texts = texts.select(*keys, text).repartition(*keys)
    trimmed = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    pieces = F.array_append(F.split(trimmed, SPACE), F.lit(None).cast("string"))  # the null stands for the row itself
    held = texts.select(*keys, F.explode(pieces).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    is_word = F.col("word") != ""
    counted = held.groupBy(*keys).agg(
        F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("n_rows"), F.coalesce(F.sum(F.when(is_word, F.col("n"))), F.lit(0)).alias("all_words"),
        F.count(F.when(is_word, True)).alias("distinct_words"))
    return counted.select(*keys, "n_rows", F.expr("all_words div n_rows").alias("words"), "distinct_words")


def _bits(flags: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0)).cast("int")


def failed_sets(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, good, toxic, failed, n)``: rows of each part and label, by the set of filters that they fail.

    ``failed`` has bit 0 for A (under 200 words), 1 for B (under half of the
    words distinct), 2 for C (over two per cent of the code points in A-Z), 3 for
    D (holds a sign of ``SIGNS``) and 4 for E (the text of a smaller id).  Null
    texts are empty, null parts the empty string.  A row of null id is compared
    with no other: it never fails E, and has no label.  Rows that repeat id and
    text count one by one; the first id of a text keeps all its rows.  Of labels
    that repeat an id, one that says 1 is enough.

    Whole texts are shuffled once, by id and a 64-bit hash of the text, for their
    words; equal texts are told by SHA-256.  Copies, however many, are summed
    before they meet: only the least id of each part is compared.
    """
    text, keys = F.coalesce(F.col(text_col).cast("string"), F.lit("")), ["id", "text_hash"]
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    words = word_totals(base.select(*keys, "text"), keys).select(F.col("id").alias("w_id"), F.col("text_hash").alias("w_hash"), "words", "distinct_words")
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    other = base.select(
        *keys, "part", F.unhex(F.sha2("text", 256)).alias("text_key"), (100 * capitals > 2 * F.char_length("text")).alias("c"), F.col("text").rlike(SIGNS).alias("d"))
    other = other.groupBy(*keys, "part", "text_key", "c", "d").agg(F.count(F.lit(1)).alias("rows"))
    told = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("quality") == 1).alias("quality"), F.max(F.col("toxic") == 1).alias("bad"))
    known = (
        other.join(words, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")), "left_outer")
        .join(told, F.col("id") == F.col("l_id"), "left_outer"))
    n, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    rows = known.select(
        "text_key", "part", "id", "rows", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("toxic"),
        _bits([n < 200, 100 * distinct < 50 * n, F.col("c"), F.col("d")]).alias("failed"))
    # Copies of a text: only the rows of the least id do not fail E.
    nameless = F.col("id").isNull().alias("nameless")
    alike = rows.groupBy("text_key", "part", "good", "toxic", "failed", nameless).agg(F.sum("rows").alias("n"), F.min(F.struct("id", "rows")).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("text_key"))
    e = F.when(F.col("nameless"), F.lit(0)).otherwise(F.col("n") - F.when(F.col("least.id") == first, F.col("least.rows")).otherwise(0))
    split = alike.withColumn("e", e)
    both = F.array(F.struct(F.col("failed"), (F.col("n") - F.col("e")).alias("n")), F.struct((F.col("failed") + 16).alias("failed"), F.col("e").alias("n")))
    return split.select("part", "good", "toxic", F.inline(both)).groupBy("part", "good", "toxic", "failed").agg(F.sum("n").alias("n"))


def steps_of_all_orders(filters: str) -> list[dict]:
    """Every step of every order: the filters before it and its own as bits."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [{"filter_order": "".join(order), "step": i + 1, "own": bit[f], "prior": sum(bit[g] for g in order[:i])} for order in permutations(filters) for i, f in enumerate(order)]


def audit_orders(failed: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` from ``failed_sets``.

    One row per part, order and step, zeros included; ``shapley`` is what the
    step's filter removes, summed over all orders.  The rows grow with the parts
    alone.  An empty input gives an empty result.
    """
    sets = 1 << len(filters)
    counted = failed.groupBy("part", "good", "toxic").agg(*[F.sum(F.when(F.col("failed") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(sets)])
    shape = "array<struct<filter_order:string,step:int,own:int,prior:int>>"
    steps = counted.select("part", "good", "toxic", F.array(*[f"n{s}" for s in range(sets)]).alias("c"), F.inline(F.from_json(F.lit(json.dumps(steps_of_all_orders(filters))), shape)))

    def over(condition: str) -> Column:
        return F.expr(f"aggregate(sequence(0, {sets - 1}), 0L, (a, s) -> a + IF({condition}, c[s], 0L))")

    each = steps.select(
        "part", "filter_order", "step", "own", "good", "toxic", over("(s & (prior | own)) = 0").alias("kept"), over("(s & prior) = 0 AND (s & own) <> 0").alias("removed"),
        over("(s & prior) <> 0 AND (s & own) <> 0").alias("redundant"), F.expr("c[own]").alias("unique_fails"))
    summed = each.groupBy("part", "filter_order", "step", "own").agg(
        *[F.sum(x).alias(x) for x in ("kept", "removed", "redundant", "unique_fails")],
        F.sum(F.when(F.col("good"), F.col("removed")).otherwise(0)).alias("good_lost"), F.sum(F.when(F.col("toxic"), F.col("removed")).otherwise(0)).alias("toxic_lost"))
    return summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")  # 24 rows of each order and filter


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The effect of five text filters on each part of ``docs``, in all 120 orders (see ``failed_sets``, ``audit_orders``).

    Texts of any length are read whole.  Only the named columns of ``docs`` and
    ``doc_id``, ``quality``, ``toxic`` of ``labels`` are read, so others cannot
    clash; an empty table gives an empty result.
    """
    return audit_orders(failed_sets(docs, labels, id_col, text_col, part_col))
