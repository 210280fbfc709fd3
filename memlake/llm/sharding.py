"""Uniform shuffle into shards of exact size (operator 3, native).

A hypergeometric communication matrix says how many rows of each partition go
to each shard.  It is drawn exactly, so row sums are the partitions' sizes and
column sums the shards' sizes.  Rows are permuted inside their partition by a
hash, dealt out by the matrix, exchanged, and permuted again inside their shard.
Only the matrix (partitions x shards numbers, both parameters) passes through
the driver; rows see DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.plans.names import free_names
from memlake.plans.numbering import gapless_number


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls, taken from good + bad without return, are good: inversion outward from the mode."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    lo = hi = (draws + 1) * (good + 1) // (good + bad + 2)

    def ln_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    below = above = math.exp(ln_choose(good, lo) + ln_choose(bad, draws - lo) - ln_choose(good + bad, draws))
    left = rng.random() - below
    least, most = max(0, draws - bad), min(draws, good)
    while left > 0 and (lo > least or hi < most):
        if hi < most:
            above *= (good - hi) * (draws - hi) / ((hi + 1) * (bad - draws + hi + 1))
            hi += 1
            left -= above
            if left <= 0:
                return hi
        if lo > least:
            below *= lo * (bad - draws + lo) / ((good - lo + 1) * (draws - lo + 1))
            lo -= 1
            left -= below
            if left <= 0:
                return lo
    return (draws + 1) * (good + 1) // (good + bad + 2)


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows: partitions with ``sizes``; columns: shards.  A draw from the law that a uniform shuffle gives."""
    rng = random.Random(seed)
    room = list(shards)
    matrix = []
    for size in sizes:
        row, left, other = [], size, sum(room)
        for j, free in enumerate(room):
            other -= free
            row.append(hypergeometric(rng, free, other, left))
            left -= row[-1]
            room[j] -= row[-1]
        matrix.append(row)
    return matrix


def shard_rows(
    df: DataFrame, key_cols: list[str], shards: int = 8, partitions: int | None = None, seed: int = 17, shard_col: str = "shard", slot_col: str = "slot",
    rows_per_partition: int = 200_000,
) -> DataFrame:
    """Add ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard); all columns and rows stay.

    Shard sizes are at most one apart and the order is a uniform shuffle, set by
    ``seed`` and the values of ``key_cols`` alone, whatever the file layout.
    ``partitions`` is the number of hash partitions that the matrix deals out;
    by default one for each ``rows_per_partition`` rows, 256 at least: choose it
    so that one of them fits a task.  Nulls in the keys are a value as any
    other.  Rows equal in all keys may swap places; an empty table gives an
    empty result.  Existing columns named as the new ones are replaced, no other
    column is touched.
    """
    spark = df.sparkSession
    df = df.drop(shard_col, slot_col)
    if partitions is None:
        partitions = max(256, -(-df.count() // rows_per_partition))
    part, at, ends_col = free_names(df, "__p", "__at", "__ends")
    keyed = df.withColumn(part, F.pmod(F.xxhash64(F.lit(seed), *key_cols), F.lit(partitions)).cast("int"))
    found = {r[part]: r["count"] for r in keyed.groupBy(part).count().collect()}  # at most `partitions` rows
    sizes = [found.get(p, 0) for p in range(partitions)]
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(sizes, room, seed)
    ends = [list(accumulate(row)) for row in matrix]
    deal = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{part: p, ends_col: e} for p, e in enumerate(ends)])), f"array<struct<{part}:int,{ends_col}:array<bigint>>>")).alias("d")).select("d.*")
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed + 1), *key_cols), *key_cols)
    dealt = (
        keyed.withColumn(at, F.row_number().over(local))
        .join(F.broadcast(deal), part)  # partitions x shards numbers
        .withColumn(shard_col, F.size(F.filter(ends_col, lambda e: e < F.col(at))).cast("int"))
        .drop(part, at, ends_col))
    buckets = max(64, -(-total // (shards * rows_per_partition)))
    return gapless_number(dealt, [shard_col], F.xxhash64(F.lit(seed + 2), *key_cols), slot_col, buckets, ties=tuple(key_cols))
