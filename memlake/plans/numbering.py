"""Gapless numbers inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.plans.names import free_names


def gapless_number(df: DataFrame, groups: list[str], order: Column, out: str, buckets: int = 64, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: 0, 1, ... inside each group, by a 64-bit ``order`` value.

    ``order`` is a bigint column, spread evenly (a hash).  Its top bits cut each
    group into ``buckets`` ranges; rows are counted per range, numbered inside
    the range, and shifted by the rows of the ranges before.  A group that holds
    a third of all rows so spreads over ``buckets`` tasks.  ``ties`` names
    columns that settle equal hashes; fully equal rows are interchangeable.
    """
    at, bucket, held, start, row, *names = free_names(df, "__o", "__b", "__n", "__start", "__r", *[f"__g{i}" for i in range(len(groups))])
    keyed = df.withColumns({
        **{n: F.coalesce(F.concat(F.lit("v"), F.col(g).cast("string")), F.lit("n")) for n, g in zip(names, groups)},
        at: order,
    }).withColumn(bucket, F.pmod(F.shiftrightunsigned(F.col(at), 33), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(*names, bucket).agg(F.count(F.lit(1)).alias(held))
    before = Window.partitionBy(*names).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*names, bucket, F.coalesce(F.sum(held).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(*names, bucket).orderBy(at, *ties)
    numbered = keyed.withColumn(row, F.row_number().over(inside))
    return (
        numbered.join(starts, [*names, bucket])
        .withColumn(out, (F.col(start) + F.col(row) - 1).cast("long"))
        .drop(*names, at, bucket, start, row)
    )
