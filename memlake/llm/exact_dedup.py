"""Exact dedup through counting quotient filters (operator 1).

A 64-bit fingerprint of the normalised text is cut into a slice (its top bits,
which deal the work to tasks), a quotient and a remainder.  Each partition
builds one counting quotient filter per slice: which quotients occur, where each
run of remainders ends, the sorted remainders, and the counters above one.
Quotient and remainder give the fingerprint back, so filters of one slice merge
without loss by merging their sorted remainders.  Fingerprints with a count
above one go on to byte verification: the rows behind them are grouped by their
whole normalised text.  All other rows are alone.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.plans.shared import SharedStage

U64 = np.uint64
#: Up to so many repeated fingerprints are broadcast; beyond, rows meet them in a shuffle.
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    # Single spaces stay as they are, so the pattern need not match them.
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def encode_filter(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of ascending distinct ``bits``-bit values."""
    n = len(values)
    q = min(bits - 1, max(1, math.ceil(math.log2(max(n, 2)))))
    r = bits - q
    quotient = (values >> U64(r)).astype(np.int64)
    remainder = values & U64((1 << r) - 1)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotient] = 1
    ends = np.ones(n, np.uint8)
    ends[:-1] = quotient[1:] != quotient[:-1]
    width = (r + 7) // 8
    slots = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    many = np.flatnonzero(counts > 1)
    return b"".join([
        struct.pack("<BBII", q, r, n, len(many)), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        np.ascontiguousarray(slots).tobytes(), many.astype("<u4").tobytes(), counts[many].astype("<u8").tobytes()])


def decode_filter(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values ascending, counts) of an encoded filter."""
    q, r, n, m = struct.unpack_from("<BBII", raw)
    at = struct.calcsize("<BBII")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    occupied = np.flatnonzero(np.unpackbits(take("u1", ((1 << q) + 7) // 8), count=1 << q))
    ends = np.flatnonzero(np.unpackbits(take("u1", (n + 7) // 8), count=n))
    width = (r + 7) // 8
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = take("u1", n * width).reshape(n, width)
    quotient = np.repeat(occupied, np.diff(ends, prepend=-1)).astype(U64)
    counts = np.ones(n, np.int64)
    many = take("<u4", m)
    counts[many] = take("<u8", m)
    return (quotient << U64(r)) | slots.view("<u8").ravel().astype(U64), counts


def merge_filters(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Filters of one slice merged: values ascending, counts added."""
    parts = [decode_filter(f) for f in filters]
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")  # merges runs that are sorted already
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


def _build(slice_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for batch in batches:
            more = np.sort(batch.column(0).to_numpy(zero_copy_only=False).view(U64))
            values, n = np.unique(more, return_counts=True)
            held = np.concatenate([held, values])
            order = np.argsort(held, kind="stable")
            held, counts = held[order], np.concatenate([counts, n])[order]
            first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            held, counts = held[first], np.add.reduceat(counts, first)
        if not len(held):
            return
        bits = 64 - slice_bits
        part = (held >> U64(bits)).astype(np.int64)
        rest = held & U64((1 << bits) - 1)
        names, first = np.unique(part, return_index=True)
        cut = [*first.tolist(), len(held)]
        filters = [encode_filter(rest[a:b], counts[a:b], bits) for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(filters, pa.binary())], ["part", "filter"])

    return run


def _repeated(slice_bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values, counts = merge_filters(table["filter"].to_pylist())
        many = counts > 1
        whole = values[many] | (U64(key[0].as_py()) << U64(64 - slice_bits))
        return pa.table({"fp": pa.array(whole.view(np.int64)), "fp_count": pa.array(counts[many])})

    return run


def repeated_fingerprints(fingerprints: DataFrame, slice_bits: int) -> DataFrame:
    """``(fp, fp_count)`` of the values of a one-column bigint DataFrame that occur more than once."""
    built = fingerprints.mapInArrow(_build(slice_bits), "part int, filter binary")
    return built.groupBy("part").applyInArrow(_repeated(slice_bits), "fp long, fp_count long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bits: int | None = None) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when they are the same bytes after each run of ASCII white
    space became one space; null counts as empty.  The row with the least id
    stays; null ids come after all others, and a group of null ids only has a
    null ``keep_id`` and keeps its rows.  Rows that repeat id and text both say
    ``kept``: nothing tells them apart.  ``slice_bits`` sets how many tasks
    share the filters (default: by the shuffle partitions, and so that one
    decodes about four million fingerprints).  A text that a third of all rows
    share is summed up per task before any shuffle.  Only the two named columns
    are read, so others cannot clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    if slice_bits is None:
        slices = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() >> 22)
        slice_bits = math.ceil(math.log2(slices))
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    marked = base.withColumn("fp", F.xxhash64("norm"))
    repeated = SharedStage(spark, "exact").put(repeated_fingerprints(marked.select("fp"), slice_bits).select("fp"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)  # 8 bytes each, counted
    # Byte verification: only rows with a repeated fingerprint, by their whole text.
    groups = (
        marked.join(repeated, "fp").groupBy("norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    own = base.select("id", F.sha2("norm", 256).alias("text_sha256"))
    return own.join(groups, "text_sha256", "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256")
