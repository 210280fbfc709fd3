"""Exact similarity join by metric partitioning.

The angle between vectors is a metric.  Vectors go to the cell of their nearest
pivot; a cell is cut into rings by the angle to its pivot, so that a block (a
ring, or a piece of one) has a bounded number of members.  Vectors at most an
angle ``reach`` apart can only lie in blocks that the triangle inequality lets
meet: the angles to the later block's pivot differ by ``reach`` at most, and the
earlier vector is at most twice ``reach`` nearer to its own pivot than to the
other.  Every vector visits the later blocks that it may meet, and matrix
products inside tasks compare visitors and members.  Vectors that are equal make
one class, which only its least id speaks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.operators.vector import _matrix, _unit
from memlake.plans.shared import SharedStage

#: Bins of a right angle that rings are made of.
BINS = 1024
#: Rounding of angles, in radians; bounds are widened by it.
SLACK = 1e-6


def equal_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, class_id)``: the least id with the same vector; rows without a vector are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    return rows.withColumn("key", F.xxhash64("v")).join(_classes(rows).select(F.xxhash64("v").alias("key"), F.col("v").alias("of"), F.col("id").alias("class_id")), "key").where(
        F.col("v") == F.col("of")).select("id", "class_id")


def _classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def _with(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.DataType.fromDDL(more).fields])


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(m) @ pivots.T, -1, 1))


def _homes(pivots: np.ndarray):
    """Each vector's nearest pivot and the angle to it, in bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                angles = _angles(_matrix(batch.column("v")), pivots)
                cell = angles.argmin(axis=1)
                bins = np.floor(angles[np.arange(len(cell)), cell] * (2 * BINS / math.pi)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(bins)], ["id", "v", "cell", "bin"])

    return run


def _visits(pivots: np.ndarray, reach: float):
    """The cells from its own on that each vector may have partners in, with its angle to their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                angles, home = _angles(_matrix(part.column("v")), pivots), part.column("cell").to_numpy()
                own = angles[np.arange(len(home)), home]
                row, cell = np.nonzero((angles - own[:, None] <= 2 * reach + SLACK) & (np.arange(len(pivots))[None, :] >= home[:, None]))
                taken = part.select(["id", "v", "block"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(angles[row, cell])], ["id", "v", "block", "to_cell", "angle"])

    return run


def _compare(low: float, high: float):
    def run(table: pa.Table) -> pa.Table:
        member, ids = table["member"].to_numpy(), table["id"].to_numpy()
        inside = bool(table["inside"][0].as_py())
        m = _unit(_matrix(table["v"].combine_chunks()))
        x, y = np.flatnonzero(member), np.flatnonzero(~member)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows, strictly in ((y, False), (x, True)) if inside else ((y, False),):
            for at in range(0, len(rows), 2048):
                some = rows[at : at + 2048]
                sims = m[some] @ m[x].T
                r, c = np.nonzero((sims >= low - 1e-12) & (sims < high) & ((ids[some][:, None] < ids[x][None, :]) if strictly else True))
                found.append((ids[some[r]], ids[x[c]], sims[r, c]))
        a, b, s = (np.concatenate(z) if found else np.zeros(0, k) for z, k in zip(zip(*found) if found else ((), (), ()), (np.int64, np.int64, float)))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    return run


class SimilarityJoin:
    """Pairs of different vectors at cosine ``low`` or more; built once, asked for pairs or for the work they take.

    ``block`` members at most meet in a task, and eight times as many visitors.
    There is a pivot for each ``block`` vectors, up to ``most_pivots``: vectors
    picked by a hash of the id, whose number bounds what the driver holds and
    sends.  Where vectors stand in clusters narrower than the angle asked for,
    few cells meet; where they lie evenly in many dimensions no exact join can
    leave pairs out, all blocks meet, and ``compared`` says so.  A cosine of 0 or
    less lets every block meet.  Null vectors are left out; a zero vector has
    cosine 0.
    """

    def __init__(self, vectors: DataFrame, low: float, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048, most_pivots: int = 1024):
        self.low, self.block, spark = low, block, vectors.sparkSession
        self.stage = SharedStage(spark, "similar")
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
        one_each = _classes(rows)
        if low > 0:
            one_each = one_each.where(F.exists("v", lambda x: x != 0))
        self.reach = math.acos(min(low, 1.0)) if low > 0 else math.pi
        base = self.stage.put(one_each, "classes")
        self.rows = base.count()
        picked = base.orderBy(F.xxhash64("id"), "id").limit(min(most_pivots, max(1, -(-self.rows // block)))).collect()
        self.pivots = _unit(np.array([list(r["v"]) for r in picked], np.float64)) if picked else np.zeros((0, 1))
        self.homes = self.stage.put(base.mapInArrow(_homes(self.pivots), _with(base, "cell int, bin int")), "homes")
        self.members = self.stage.put(self._members(), "members")

    def _members(self) -> DataFrame:
        """Every vector with its block; blocks are numbered, and none has many more than ``block`` members."""
        counts = self.homes.groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 2 x BINS rows of a cell at most
        bins = counts.withColumn("ring", F.floor((before + F.col("n") / 2) / self.block))
        rings = bins.groupBy("cell", "ring").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("n").alias("held")).withColumn("pieces", F.ceil(F.col("held") / self.block).cast("int"))
        self.rings = self.stage.put(rings, "rings")
        placed = self.homes.join(bins.select("cell", "bin", "ring"), ["cell", "bin"]).join(self.rings.select("cell", "ring", "pieces"), ["cell", "ring"])
        piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
        return placed.select("id", "v", "cell", F.struct("cell", "ring", piece.alias("piece")).alias("block"))

    def _met(self) -> DataFrame:
        """``(id, v, to)``: the later blocks that each vector visits."""
        width = math.pi / (2 * BINS)
        seen = self.members.mapInArrow(_visits(self.pivots, self.reach), _with(self.members.select("id", "v", "block"), "to_cell int, angle double"))
        meets = (F.col("lo") * width - self.reach - SLACK <= F.col("angle")) & (F.col("angle") <= (F.col("hi") + 1) * width + self.reach + SLACK)
        near = seen.join(self.rings.withColumnRenamed("cell", "to_cell"), "to_cell").where(meets)
        to = F.struct(F.col("to_cell").alias("cell"), "ring", "piece")
        return near.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("to", to).where(F.col("block") < F.col("to")).select("id", "v", "to")

    def _counts(self) -> DataFrame:
        """Members and visitors of each block."""
        members = self.members.groupBy(F.col("block").alias("to")).agg(F.count(F.lit(1)).alias("members"))
        visitors = self._met().groupBy("to").agg(F.count(F.lit(1)).alias("visitors"))
        return members.join(visitors, "to", "left").withColumn("visitors", F.coalesce("visitors", F.lit(0)))

    def compared(self) -> DataFrame:
        """One row: ``vectors`` that differ, ``compared`` pairs, and their ``share`` of all pairs."""
        work = F.col("members") * (F.col("members") - 1) / 2 + F.col("members") * F.col("visitors")
        total = F.lit(max(1.0, self.rows * (self.rows - 1) / 2))
        return self._counts().agg(F.coalesce(F.sum(work), F.lit(0)).cast("long").alias("compared")).select(F.lit(self.rows).alias("vectors"), "compared", (F.col("compared") / total).alias("share"))

    def pairs(self, high: float = 2.0) -> DataFrame:
        """``(a, b, similarity)`` with a < b and low <= cosine < high."""
        chunks = F.greatest(F.lit(1), F.ceil(F.col("visitors") / (8 * self.block))).cast("int")
        dealt = self.stage.put(self._counts().withColumn("chunks", chunks).select("to", "chunks"), "chunks")
        own = self.members.select("id", "v", F.col("block").alias("to")).join(dealt, "to").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        visiting = self._met().join(dealt, "to").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        both = own.select("to", "chunk", F.lit(True).alias("member"), "id", "v").unionByName(visiting.select("to", "chunk", F.lit(False).alias("member"), "id", "v"))
        both = both.withColumn("inside", F.col("chunk") == 0)
        return both.groupBy("to", "chunk").applyInArrow(_compare(self.low, high), "a long, b long, similarity double")


def similar_pairs(vectors: DataFrame, low: float, high: float = 2.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048) -> DataFrame:
    """``(a, b, similarity)`` of different vectors with a < b and low <= cosine < high; exact (see ``SimilarityJoin``).

    Ids are those of classes of equal vectors; ``equal_vectors`` tells who belongs to them.
    """
    return SimilarityJoin(vectors, low, id_col, vec_col, block).pairs(high)
