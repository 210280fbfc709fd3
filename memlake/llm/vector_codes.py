"""Product codes of vectors in whole numbers, with annular norm pruning (operator 13).

A vector's components become integers and the vector is cut into parts; each
part position has a codebook whose nearest entry codes the part.  The search for
the nearest entry keeps the codebook sorted by norm.  By the triangle inequality
an entry at distance d or less of a part has a norm within d of the part's, so
the current best distance bounds an interval of the sorted norms, found by binary
search; only entries inside it, ends included, are evaluated, exactly.  The best
distance at the start is that of the entry of the nearest norm, then that of
growing slices around it.

A round of training is one pass: tasks assign their parts and bring sums per
codebook entry, which Spark adds up.  Codebooks, at most parts x entries rows,
are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.plans.shared import SharedStage

BROADCAST_ROWS = 100_000
#: Components up to this size: squared distances of up to 2048 components are exact in doubles.
EXACT_IN_DOUBLES = 1 << 20
#: Components beyond this, scaled, have sums and errors of no use; their rows go like those of non-finite ones.
LARGEST = 1e27
#: Parts of like norm that are searched together.
TOGETHER = 64


class AnnularCodebook:
    """One part position's entries, sorted by norm, for exact nearest-entry search (ties to the lower index)."""

    def __init__(self, entries: np.ndarray):
        entries = np.asarray(entries)
        self.whole = entries.dtype == object or (entries.size and int(np.abs(entries).max()) > EXACT_IN_DOUBLES)
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.floats = self.entries.astype(np.float64)
        self.squares = (self.floats**2).sum(axis=1)
        self.evaluated = 0

    def _distances(self, parts: np.ndarray, low: int, high: int) -> np.ndarray:
        """Exact squared distances of some parts to the entries ``low`` to ``high`` of the order."""
        self.evaluated += len(parts) * (high - low)
        if self.whole or parts.dtype == object:  # Python's integers, of any size
            gap = parts[:, None, :].astype(object) - self.entries[None, low:high].astype(object)
            return (gap * gap).sum(axis=2)
        return (parts**2).sum(axis=1)[:, None] - 2 * (parts @ self.floats[low:high].T) + self.squares[None, low:high]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry index, squared distance) of each part; parts are integers of any size."""
        parts = np.asarray(parts)
        if parts.dtype != object and parts.size and int(np.abs(parts).max()) > EXACT_IN_DOUBLES:
            parts = parts.astype(object)
        if parts.dtype != object:
            parts = parts.astype(np.float64)
        norms = np.sqrt((parts.astype(np.float64) ** 2).sum(axis=1))
        index, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype if not self.whole else object)
        by_norm = np.argsort(norms, kind="stable")
        for at in range(0, len(parts), TOGETHER):
            rows = by_norm[at : at + TOGETHER]
            index[rows], best[rows] = self._search(parts[rows], norms[rows])
        return index, best

    def _search(self, parts: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of like norm: slices around the nearest norm, then what the best distances still allow."""
        count = len(self.norms)
        middle, width = int(np.searchsorted(self.norms, norms[len(norms) // 2])), 16
        low, high = max(0, min(middle, count - 1) - width // 2), min(count, middle + width // 2 + 1)
        found = self._distances(parts, low, high)
        best, place = self._least(found, low)
        while True:
            # The interval that the best distances allow, ends included; rounding can only widen it.
            reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + norms * 1e-9 + 1e-6
            first, last = int(np.searchsorted(self.norms, (norms - reach).min(), "left")), int(np.searchsorted(self.norms, (norms + reach).max(), "right"))
            if first >= low and last <= high:
                return self.order[place], best
            width *= 2
            for a, b in ((max(first, low - width), low), (high, min(last, high + width))):
                if a < b:
                    more, spot = self._least(self._distances(parts, a, b), a)
                    nearer = (more < best) | ((more == best) & (self.order[spot] < self.order[place]))
                    best, place = np.where(nearer, more, best), np.where(nearer, spot, place)
            low, high = min(low, max(first, low - width)), max(high, min(last, high + width))

    def _least(self, found: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each row and its place in the order; of equal ones the lower index."""
        least = found.min(axis=1)
        names = np.where(found == least[:, None], self.order[None, low : low + found.shape[1]], len(self.order))
        return least, low + names.argmin(axis=1)


def bounds(dims: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; equal lengths if ``parts`` divides ``dims``."""
    return [dims * i // parts for i in range(parts + 1)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal lists of doubles that are whole numbers: a row each; Python's integers beyond 2**53."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return values if not values.size or np.abs(values).max() < 2.0**53 else np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def _sums(books: list[list[list[int]]], cut: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [AnnularCodebook(np.array(b, object if _large(b) else np.int64)) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros((len(b), len(b[0])), object) for b in books]
        seen = False
        for batch in batches:
            vectors, seen = _matrix(batch.column("whole")), seen or len(batch) > 0
            for p, book in enumerate(search):
                part = vectors[:, cut[p] : cut[p + 1]]
                index, _ = book.nearest(part)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                if part.dtype == object or np.abs(part).max(initial=0) * len(part) >= 2.0**53:
                    np.add.at(totals[p], index, np.array([[int(x) for x in row] for row in part], object))
                else:
                    one = np.zeros((len(part), len(totals[p])))
                    one[np.arange(len(part)), index] = 1
                    totals[p] += (one.T @ part).astype(np.int64)
        if seen:
            used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in used], pa.int32()), pa.array([int(e) for _, e in used], pa.int32()), pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
                 pa.array([",".join(map(str, totals[p][e])) for p, e in used])], ["part", "entry", "n", "sums"])

    return run


def _large(rows: list[list[int]]) -> bool:
    return any(abs(x) >= 1 << 53 for row in rows for x in row)


def _codes(books: list[list[list[int]]], cut: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [AnnularCodebook(np.array(b, object if _large(b) else np.int64)) for b in books]
        for batch in batches:
            vectors, codes, error = _matrix(batch.column("whole")), [], 0
            for p, book in enumerate(search):
                index, far = book.nearest(vectors[:, cut[p] : cut[p + 1]])
                codes.append(index)
                error = error + (far if far.dtype == object else far.astype(np.int64))
            shown = ["".join(f"{c:02x}" for c in row) for row in np.column_stack(codes).tolist()]
            longs = [int(e) if int(e) < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(shown), pa.array(longs, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``(vec_id, label, whole)``: rows whose vectors have finite components only, each as floor(scale * x)."""
    scaled = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale).alias("v"))
    sound = scaled.where((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)) & ~F.isnan(x)))

    def floor(x):  # as a double, of any size
        cut = x - x % 1
        return F.when(x < cut, cut - 1).otherwise(cut)

    return sound.select("vec_id", "label", F.transform("v", floor).alias("whole"))


def train_codebooks(whole: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[list[list[int]]]:
    """Codebooks by part, entry and position: the first vectors' parts, then ``rounds`` of assigning and averaging (floor)."""
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()  # `entries` rows
    if not first:
        return []
    cut = bounds(len(first[0].whole), parts)
    books = [[[int(x) for x in r.whole[a:b]] for r in first] for a, b in zip(cut, cut[1:])]
    for _ in range(rounds):
        told = whole.mapInArrow(_sums(books, cut), "part int, entry int, n long, sums string")
        pieces = F.transform(F.split("sums", ","), lambda s: s.cast("decimal(38,0)"))
        spread = told.select("part", "entry", "n", F.posexplode(pieces).alias("at", "x"))
        added = spread.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").cast("string").alias("x"))
        for r in added.collect():  # parts x entries x positions at most
            books[r.part][r.entry][r["at"]] = int(r.x) // r.n
    return books


def codebooks_sha256(books: list[list[list[int]]]) -> str:
    """Hex of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of each vector with finite components only.

    ``code`` has two hex digits per part (``entries`` is 256 at most), ``error``
    the squared distance of the vector to its coded form, ``label_error`` the sum
    of the errors of its label; null labels are one.  The codebooks start from
    the vectors of the least ids (equal ids by their components, null ids last);
    with fewer vectors than ``entries`` they are shorter.  All vectors are of the
    length of the first of these; others have no distance to them and are
    dropped, as are empty ones.  A length that ``parts`` does not divide is cut as
    evenly as it goes.  A component of 1e27 or more, scaled, counts as not finite.  Errors beyond a long are null.  Repeated rows each get
    their row.  Only the three named columns are read, so others cannot clash; an
    empty table gives an empty result.

    Every row is read ``rounds`` + 2 times, never shuffled: a task brings one
    sum per entry that it used.  Sums per label are few rows per task; where more
    than ``BROADCAST_ROWS`` labels exist they are joined by a shuffle.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    spark = vectors.sparkSession
    stage = SharedStage(spark, "codes")
    whole = stage.put(whole_vectors(vectors, id_col, vector_col, label_col, scale), "whole")
    head = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select(F.size("whole").alias("dims")).first()
    even = whole.where(F.size("whole") == (head.dims if head else 0))
    books = train_codebooks(even, parts, entries, rounds)
    cut = bounds(head.dims if head else parts, parts)
    shape = T.StructType([*[T.StructField(c, whole.schema[c].dataType) for c in ("vec_id", "label")], *T.DataType.fromDDL("code string, error long").fields])
    coded = stage.put(even.mapInArrow(_codes(books, cut), shape), "coded")
    sums = stage.put(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "l"), "labels")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)  # counted
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
