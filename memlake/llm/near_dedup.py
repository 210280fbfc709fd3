"""MinHash near-dedup with SuperMinHash signatures (operator 9).

Steps, all on Spark:

1. Each text becomes its set of distinct word shingles (64-bit hashes), the
   set's size, a 128-bit fingerprint of the set and a SuperMinHash signature.
   SuperMinHash gives every element a random permutation of the signature's
   positions and the ranks 0, 1, ... along it, plus a fraction; a position holds
   the least value that any element brought.  Ranks are worked off level by
   level over the whole batch, and a row stops as soon as every position holds
   a value below the next rank, which is the early stop of the sketch.
2. Equal sets collapse to classes, known by a 128-bit fingerprint of the set.
   Only one member of a class goes on.
3. Bands of ``rows`` signature positions make bucket keys.  A pair with
   similarity s shares no bucket with probability (1 - s**rows)**bands: 3e-6 at
   0.8 with the default 24 bands of 4 rows, and less above.
4. First links: each class against the class that is least in most of its
   buckets, confirmed on the full sets; components by a parallel union-find
   (``connected_components`` contracts the graph of links until one task can end it).
5. Rest: pairs of one bucket that are still in different components.  Buckets
   of up to ``bucket_pairs`` classes give their pairs, confirmed on full sets.
   Larger ones are compared block by block inside tasks: products of 0/1
   matrices give the exact sizes of all intersections, and only links that join
   two components leave the task, at most one per class.  Pairs inside one
   component need no check: they cannot change the answer.  A second union-find
   over these links, whose nodes are the components found so far, ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import textvec as tv
from memlake.operators.components import connected_components
from memlake.plans.shared import SharedStage

U64 = np.uint64
RANK = U64(32)  # a value is rank << 32 | fraction


def superminhash(values: np.ndarray, of_row: np.ndarray, size: int) -> np.ndarray:
    """(rows, size) signatures of each row's set of 64-bit hashes; empty rows stay at the maximum."""
    rows = len(of_row) - 1
    counts = np.diff(of_row)
    table = np.full(rows * size, np.iinfo(np.uint64).max, U64)
    row = np.repeat(np.arange(rows), counts)
    held = None  # the permutations of the elements of rows that go on
    with np.errstate(over="ignore"):
        for level in range(size):
            draw = tv.mix(values + U64((level * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % (1 << 64)))
            at = level + (((draw & U64(0xFFFFFFFF)) * U64(size - level)) >> RANK).astype(np.int64)
            if held is None:
                place = at
            else:
                here = np.arange(len(values))
                place = held[here, at].astype(np.int64)
                held[here, at] = held[:, level]
            np.minimum.at(table, row * size + place, (U64(level) << RANK) | (draw >> RANK))
            most = table.reshape(rows, size).max(axis=1)
            going = (most >= (U64(level + 1) << RANK)) & (counts > 0)
            if not going.any():
                break
            keep = going[row]
            if held is None:
                kind = np.uint8 if size <= 256 else np.uint16
                held = np.tile(np.arange(size, dtype=kind), (int(keep.sum()), 1))
                first = np.arange(len(held))
                held[first, at[keep]] = 0
            elif not keep.all():
                held = held[keep]
            if not keep.all():
                values, row = values[keep], row[keep]
    return table.reshape(rows, size)


def sets_of(batch: pa.RecordBatch, text: str, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, distinct shingle hashes, of_row) of each slice of a batch."""
    data, offsets = tv.utf8(batch.column(text))
    for low, high in tv.slices(offsets):
        part = tv.LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, of_row = tv.tokens(part, offsets[low : high + 1] - offsets[low])
        hashes, of_row = tv.shingles(tv.word_hashes(part, starts, ends), of_row, shingle)
        yield low, high, *tv.distinct(hashes, of_row)


def fingerprints(values: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, whatever the order."""
    with np.errstate(over="ignore"):
        return (tv.row_sums(tv.mix(values), of_row).view(np.int64), tv.row_sums(tv.mix(values ^ U64(0x6A09E667F3BCC909)), of_row).view(np.int64))


def nodes(values: np.ndarray, of_row: np.ndarray) -> list[bytes]:
    """The 128-bit fingerprint of each row's set as 16 bytes."""
    raw = np.column_stack(fingerprints(values, of_row)).astype("<i8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _sketches(shingle: int, bands: int, rows: int):
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, of_row in sets_of(batch, "text", shingle):
                table = superminhash(values, of_row, size)
                with np.errstate(over="ignore"):
                    key = np.zeros((high - low, bands), U64)
                    for j in range(rows):
                        key = tv.mix(key * U64(31) + table[:, j::rows] + U64(j + 1))
                    key = tv.mix(key + np.arange(1, bands + 1, dtype=U64)[None, :])
                keys = pa.ListArray.from_arrays(np.arange(0, (high - low) * bands + 1, bands, dtype=np.int32), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(low, high - low), batch.column("row_hash").slice(low, high - low), pa.array(np.diff(of_row)),
                     pa.array(nodes(values, of_row), pa.binary()), keys], ["id", "row_hash", "n", "node", "bands"])

    return run


def _set_rows(shingle: int):
    """The sets of the rows asked for, each class once in a task, however often its row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            asked = batch.column("node").to_pylist()
            for low, high, values, of_row in sets_of(batch, "text", shingle):
                raw, cut, own = values.tobytes(), (of_row * 8).tolist(), nodes(values, of_row)
                take = []
                for i in range(high - low):
                    if own[i] == asked[low + i] and own[i] not in done:
                        done.add(own[i])
                        take.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[i] for i in take], pa.binary()), pa.array([raw[cut[i] : cut[i + 1]] for i in take], pa.binary())], ["node", "elements"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a = np.frombuffer(left[i].as_buffer(), U64)
                b = np.frombuffer(right[i].as_buffer(), U64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["ca", "cb"]).filter(pa.array(keep))

    return run


def common_sizes(first: list[np.ndarray], second: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of 0/1 matrices, some columns at a time."""
    sets = [*first, *second]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # an element of one set is in no intersection
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(first), len(second)), np.float32)
    for at in range(0, int(shared.sum()), columns):
        low, high = np.searchsorted(column, [at, at + columns])
        table = np.zeros((len(sets), columns), np.float32)
        table[row[low:high], column[low:high] - at] = 1
        out += table[: len(first)] @ table[len(first) :].T
    return out


def _link_blocks(percent: int):
    """Two blocks of one large bucket: links between components, at most one per class."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        coded = table["component"].combine_chunks().dictionary_encode()
        home, side = coded.indices.to_numpy(), table["block"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in table["elements"]]
        n = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(side == key[1].as_py()), np.flatnonzero(side == key[2].as_py())
        both = common_sizes([sets[i] for i in a], [sets[i] for i in b])
        linked = (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)) & (home[a][:, None] != home[b][None, :])
        x, y = home[a[np.nonzero(linked)[0]]], home[b[np.nonzero(linked)[1]]]
        root = np.arange(len(coded.dictionary))
        left, right = [], []
        while len(x):  # take one link of each tree that has any, join, and go on
            for i in np.unique(root[x], return_index=True)[1]:
                low, high = sorted((root[x[i]], root[y[i]]))
                if low != high:
                    left.append(x[i])
                    right.append(y[i])
                    root[root == high] = low
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
        name = coded.dictionary
        return pa.table({"ca": name.take(pa.array(left, pa.int64())), "cb": name.take(pa.array(right, pa.int64()))})

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = 24, rows: int = 4, bucket_pairs: int = 32, block: int = 256, mark_rows: bool = False,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Texts are lower-cased (A-Z) and cut at ASCII white space.  Rows link where
    100 * intersection >= percent * union of their distinct shingles;
    ``component_id`` is the least id that links reach, ``kept`` marks the rows
    that bear it.  A text of fewer words than a shingle is one shingle; null,
    empty and blank texts have none, link with nothing and are kept.  A row of
    null id links others, gets a null component and is kept.  Rows may repeat an
    id, with equal or other texts: each text has its own links.  A text of any
    length is read whole.  Only the two named columns are read, so other columns
    cannot clash; an empty table gives an empty result.

    With ``mark_rows``, ``row_hash`` (xxhash64 of the text) and ``stays`` come
    too: of each component's rows, those with the least (id, row_hash) stay,
    null ids last, so rows that repeat both are left.
    """
    spark = docs.sparkSession
    stage = SharedStage(spark, "near")
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("row_hash"))
    seen = stage.put(
        base.mapInArrow(_sketches(shingle, bands, rows), "id long, row_hash long, n long, node binary, bands array<long>"), "sketches")
    # Equal sets make one class; its first row speaks for it.
    first_row = F.struct(F.col("id").isNull().alias("nameless"), "id", "row_hash")
    classes = stage.put(
        seen.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct(first_row.alias("row"), "bands")).alias("m"))
        .select("node", "n", F.col("m.row").alias("row"), F.col("m.bands").alias("bands")), "classes")
    entries = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("c")).where("c > 1")
    bucketed = stage.put(entries.join(shared, "key").select("key", "node", "n", "centre"), "bucketed")
    # The sets of all classes that share a bucket with another.
    wanted = bucketed.select("node").distinct().join(classes, "node").select("node", F.col("row.id").alias("row_id"), F.col("row.row_hash").alias("asked_hash"))
    spoken = base.join(wanted, F.col("id").eqNullSafe(F.col("row_id")) & (F.col("row_hash") == F.col("asked_hash")))
    sets = stage.put(spoken.select("node", "text").mapInArrow(_set_rows(shingle), "node binary, elements binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("right")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("elements").alias("left")), "a")
            .select("ca", "cb", "left", "right").mapInArrow(_confirm(percent), "ca binary, cb binary"))

    first = (
        bucketed.where("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("less"), "centre")).alias("m"))
        .select(F.col("m.centre").alias("a"), F.col("node").alias("b"), F.col("m.centre").alias("ca"), F.col("node").alias("cb")))
    reached = connected_components(confirmed(first), "ca", "cb")
    # Buckets whose classes are in more than one component still.
    marked = bucketed.join(reached, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi")
    rest = stage.put(marked.join(mixed.select("key", "c"), "key"), "rest")
    stage.drop(bucketed)
    few = rest.where(F.col("c") <= bucket_pairs)
    x, y = few.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca")), few.select(
        "key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    fits = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = x.join(y, "key").where(fits).select("a", "b", "ca", "cb")
    # Large mixed buckets: each class meets every block of its bucket once.
    many = rest.where(F.col("c") > bucket_pairs).join(sets, "node")
    blocks = F.ceil(F.col("c") / F.lit(block)).cast("int")
    many = many.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = many.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "component", "block", "elements")
    joined = many.groupBy("key", "i", "j").applyInArrow(_link_blocks(percent), "ca binary, cb binary")
    top = connected_components(confirmed(pairs.distinct()).unionByName(joined), "ca", "cb").select(F.col("node").alias("lower"), F.col("component").alias("upper"))
    stage.drop(sets)
    stage.drop(rest)
    home = stage.put(
        classes.join(reached, "node", "left").select("node", "row", F.coalesce("component", "node").alias("lower"))
        .join(top, "lower", "left").select("node", "row", F.coalesce("upper", "lower").alias("component")), "home")
    stage.drop(classes)
    least = home.groupBy("component").agg(F.min("row").alias("least"))
    named = home.join(least, "component").select("node", "least")
    done = seen.select("id", "row_hash", "n", "node").join(named, "node", "left")
    shown = done.select(
        "id", "row_hash", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least.id", "id")).alias("component_id"),
        (F.col("least").isNull() | F.col("id").eqNullSafe(F.col("least.id")) & (F.col("row_hash") == F.col("least.row_hash"))).alias("stays"))
    shown = shown.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return shown if mark_rows else shown.drop("row_hash", "stays")
