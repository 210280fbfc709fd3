"""The mix of sources: one schedule for any number of rows and sources, whether the driver or tasks find it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlake.llm import mixing as mx


def places(df):
    """All rows of a mix, by id; weights to nine digits, as sums of doubles vary with the order of files."""
    return {r["doc_id"]: (r["source"], round(r["mix_weight"], 9), r["mix_block"], r["mix_slot"], r["mix_order"], r["in_mix"]) for r in df.collect()}


def test_number_of_sources_changes_no_result(spark):
    names = [f"s{i}" for i in range(60)] * 6 + ["hot"] * 900 + [None] * 150 + [""] * 90
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    assert places(mx.mix_sources(df, ["doc_id"], block_rows=2, most_sources=16)) == places(mx.mix_sources(df, ["doc_id"], block_rows=2))


def test_number_of_rows_changes_no_block(spark):
    """4.3 million rows, by default settings: blocks of 16 rows, whole to the last one, every slot filled once."""
    rows = 4_300_000
    df = spark.range(rows).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "a").when(F.col("id") % 10 > 0, "b").otherwise("c").alias("source"))
    slots = mx.mix_sources(df, ["doc_id"]).groupBy("mix_slot").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("s"), F.max("source").alias("t"), F.min("mix_block").alias("k"))
    got = slots.agg(F.count(F.lit(1)).alias("slots"), F.min("mix_slot").alias("first"), F.max("mix_slot").alias("last"), F.max("n").alias("n"), F.sum("n").alias("rows"),
                    F.max(F.expr("s <> t")).alias("mixed"), F.count_distinct("s", "k").alias("blocks")).first()
    assert tuple(got) == (268_750, 0, 268_749, 16, rows, False, 268_750)


@pytest.mark.parametrize("chunk", [20, 10_000])
def test_chunks_of_slots_follow_the_plain_schedule(spark, chunk):
    """Heavy and light sources, equal ends and weights far apart, in chunks shorter and longer than their windows."""
    rng = random.Random(chunk)
    names = [f"s{i:02d}" for i in range(40) for _ in range(rng.choice([1, 1, 2, 9, 30]))] + ["hot"] * 400 + [None] * 45
    weights = {s: rng.choice([1.0, 0.25, 1 / 3, 1e-6, 40.5]) for s in dict.fromkeys(names) if s != "s07"}
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    for given in (None, weights):
        whole = places(mx.mix_sources(df, ["doc_id"], weights=given, block_rows=3))
        assert places(mx.mix_sources(df, ["doc_id"], weights=given, block_rows=3, driver_blocks=0, chunk_blocks=chunk)) == whole
        out = Counter(v[0] for v in whole.values() if v[3] is None)
        assert out == (Counter({"s07": names.count("s07")}) if given else Counter())
