"""Exact vector search (R1, R26, R28) and links from pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, from the flat buffer of the list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _best(ids: np.ndarray, asks: np.ndarray, own: np.ndarray, m: np.ndarray, k: int, metric: str, skip_self: bool) -> pa.Table:
    """The ``k`` best of some vectors for each of some queries."""
    if metric == "cosine":
        sims = _unit(asks) @ _unit(m).T
    else:
        sims = 1 - np.sqrt(np.maximum((asks**2).sum(1)[:, None] + (m**2).sum(1)[None, :] - 2 * asks @ m.T, 0))
    if skip_self:
        sims[ids[:, None] == own[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(own, sims.shape), -np.round(sims, 9)), axis=1)[:, :k]
    value = np.take_along_axis(sims, order, 1).ravel()
    keep = np.isfinite(value)
    return pa.table({"query_id": np.repeat(ids, order.shape[1])[keep], "id": own[order.ravel()][keep], "similarity": value[keep]})


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "embedding", id_col: str = "vec_id", vec_col: str = "embedding",
        metric: str = "cosine", block: int = 4096, skip_self: bool = False) -> DataFrame:
    """``(query_id, id, similarity, rank)``: exact top ``k``, by matrix products inside tasks.

    Up to ``block`` queries go with the code to every task, which scans its part
    of the vectors once.  More of them never pass through the driver: blocks of
    queries meet blocks of vectors in a grouped shuffle.  Either way each
    product keeps its ``k`` best per query, so what follows carries k rows per
    query and block.  ``metric``: ``cosine`` or ``one_minus_l2``.  A zero vector
    has cosine 0; null vectors are left out.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).alias("v")).where("v IS NOT NULL")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    shape = "query_id long, id long, similarity double"
    n = asked.count()
    if n <= block:
        rows = asked.orderBy("id").collect()  # `block` vectors at most
        ids, asks = np.array([r["id"] for r in rows], np.int64), np.array([list(r["v"]) for r in rows], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch) and len(ids):
                    yield from _best(ids, asks, batch.column("id").to_numpy(), _matrix(batch.column("v")), k, metric, skip_self).to_batches()

        out = base.mapInArrow(run, shape)
    else:
        parts, blocks = -(-n // block), max(1, -(-base.count() // (4 * block)))
        dealt = lambda df, own, m, other, o, is_query: df.select(
            F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(o - 1))).alias(other), F.lit(is_query).alias("asks"), "id", "v")
        both = dealt(asked, "i", parts, "j", blocks, True).unionByName(dealt(base, "j", blocks, "i", parts, False).select("i", "j", "asks", "id", "v"))

        def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            side, ids = table["asks"].to_numpy(), table["id"].to_numpy()
            m = _matrix(table["v"].combine_chunks())
            return _best(ids[side], m[side], ids[~side], m[~side], k, metric, skip_self)

        out = both.groupBy("i", "j").applyInArrow(meet, shape)
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_links(pairs: DataFrame, k: int) -> DataFrame:
    """Both directions of similarity pairs, at most ``k`` per source, best first."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "similarity"))
    order = Window.partitionBy("src").orderBy(F.round("similarity", 9).desc(), "dst")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_matches(hits: DataFrame, threshold: float) -> DataFrame:
    """The best hit of each query, if it reaches the threshold."""
    return hits.where((F.col("rank") == 1) & (F.col("similarity") >= threshold))
