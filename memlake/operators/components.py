"""Connected components of an undirected graph (operator G3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.plans.shared import SharedStage

#: Links that one task may end; more of them are contracted round by round.
IN_ONE_TASK = 10_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's least connected node, for links that fit in one task."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(root, kind), pa.array(map(find, root), kind)], ["node", "up"])


def _ordered(u: str, v: str) -> list:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def contraction(links: DataFrame, stage: SharedStage, in_one_task: int = IN_ONE_TASK) -> list[DataFrame]:
    """Maps ``(node, up)``, one per round: every node of the round's graph and the node it is merged into.

    ``links`` is a table of ``stage`` with distinct ``u < v``.  In each round
    the nodes get a random order (a hash of round and node).  Each hooks to the
    first of its neighbours, if that stands before itself, and follows these
    hooks four steps; links between merged nodes go.  Whatever the graph and its
    ids, a node has a neighbour before itself with a probability of a half or
    more, so the nodes fall to half or less per round, on average, and no
    round limit is needed.
    """
    maps: list[DataFrame] = []
    left = links.count()
    while left > in_one_task:
        order = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = both.groupBy("u").agg(F.min(order("v")).alias("m")).select(F.col("u").alias("node"), F.when(F.col("m") < order("u"), F.col("m.n")).otherwise(F.col("u")).alias("up"))
        one = stage.put(hooked, "hooks")
        two = stage.put(_follow(one, one), "hooks")
        maps.append(stage.put(_follow(two, two), "hooks"))
        stage.drop(one)
        stage.drop(two)
        ends = [maps[-1].select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("u", "v")]
        merged = links.join(ends[0], "u").join(ends[1], "v").where("u_up <> v_up").select(*_ordered("u_up", "v_up")).distinct()
        fewer = stage.put(merged, "links")
        stage.drop(links)
        links, left = fewer, fewer.count()
    if left:
        shape = T.StructType([T.StructField(c, links.schema["u"].dataType) for c in ("node", "up")])
        maps.append(stage.put(links.repartition(1).mapInArrow(_union_find, shape), "hooks"))
    stage.drop(links)
    return maps


def _follow(low: DataFrame, high: DataFrame) -> DataFrame:
    """``low``, with each ``up`` taken on through ``high`` where that knows it."""
    return low.join(high.select(F.col("node").alias("at"), F.col("up").alias("above")), F.col("up") == F.col("at"), "left").select("node", F.coalesce("above", "up").alias("up"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the least node.

    A parallel union-find: the graph is contracted round by round (see
    ``contraction``) until at most ``in_one_task`` links are left, which one task
    joins; the rounds' maps then compose from the last to the first.  Chains,
    stars and cliques of any size and order of ids settle.  Links and maps are
    written to the shared folder.  A hub's rows meet in joins that AQE can split
    and in minima with partial aggregation.  Null end points and self edges carry
    no link; a node that has only a self edge is its own component.
    """
    stage = SharedStage(edges.sparkSession, "components")
    pairs = stage.put(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*_ordered(src, dst)).distinct(), "pairs")
    maps = contraction(stage.put(pairs.where("u <> v"), "links"), stage, in_one_task)
    alone = pairs.where("u = v").select(F.col("u").alias("node"))
    if not maps:
        return alone.withColumn("component", F.col("node"))
    found = maps[-1]
    for level in reversed(maps[:-1]):
        found = stage.put(_follow(level, found), "found")
    least = found.groupBy("up").agg(F.min("node").alias("least"))
    named = found.join(least.withColumnRenamed("up", "at"), F.col("up") == F.col("at")).select("node", F.col("least").alias("component"))
    return named.unionByName(alone.join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
