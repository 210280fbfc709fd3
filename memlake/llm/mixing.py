"""Mixing sources to target weights by Pfair scheduling (operator 5, native).

The fluid mix gives every source its weight's share of each slot until the
source ends, and the others then share its part.  In virtual time v a source of
weight w has placed min(w * v, its blocks), so v is reached at slot
t(v) = sum of min(w * v, blocks) over all sources.  Block k of a source gets the
window from floor(t(k / w)) to ceil(t((k + 1) / w)): it may not be placed
before, and must be placed by then.  At each slot the released block with the
earliest deadline is placed.  The windows fill all slots exactly, so no deadline
is missed, and in every prefix every source is within less than one block of its
fluid share.  Weights are taken as exact fractions, numbers as whole numbers of
any size: nothing is rounded and nothing repeats in periods.

The schedule is one and the same for any number of rows and sources; only the
place where it is found differs.  The driver finds short ones.  Longer ones are
cut into chunks of slots, one task each (``chunked_slots``): a chunk starts from
a guess of the blocks placed before it, then from what the chunk before has
left, until no chunk has anything new.  The first chunk has no past, so each round
settles at least one more chunk, and what comes out is the driver's schedule.
Sources of equal blocks and weight have equal windows, so the driver and the
tasks hold one entry for each such class; without given weights there are fewer
than the root of twice the rows.
"""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.plans.names import free_names
from memlake.plans.numbering import gapless_number
from memlake.plans.shared import SharedStage

#: Chunks of a long schedule at most; their length grows beyond that.
MOST_CHUNKS = 1024
#: Blocks of one source whose windows are found in one go.
SPAN = 4096


def whole_weights(weights: dict) -> dict:
    """Weights (numbers, or decimals as written) as whole numbers in the same ratio."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    common = math.lcm(*[x.denominator for x in exact.values()])
    return {s: int(x * common) for s, x in exact.items()}


class Fluid:
    """The fluid mix of ``blocks`` by whole ``weights``; each entry stands for ``times`` equal sources (1 if not given)."""

    def __init__(self, blocks: dict, weights: dict, times: dict | None = None):
        self.blocks, self.weights = blocks, weights
        self.times = times or dict.fromkeys(blocks, 1)
        self.order = sorted(blocks, key=lambda s: (Fraction(blocks[s], weights[s]), s))
        self.ends = [Fraction(blocks[s], weights[s]) for s in self.order]
        self.about = [float(x) for x in self.ends]
        gone_blocks, active = 0, sum(weights[s] * self.times[s] for s in blocks)
        self.gone, self.active = [], []  # before each end: blocks of ended sources, weight of the others
        for s in self.order:
            self.gone.append(gone_blocks)
            self.active.append(active)
            gone_blocks, active = gone_blocks + blocks[s] * self.times[s], active - weights[s] * self.times[s]

    def windows(self, source, first: int = 0, last: int | None = None) -> tuple[list[int], list[int]]:
        """Releases and deadlines of the source's blocks from ``first`` to before ``last`` (all), in slots."""
        w, releases, deadlines = self.weights[source], [], []
        for k in range(first, (self.blocks[source] if last is None else last) + 1):
            at = bisect_left(self.about, k / w * (1 - 1e-12))  # not too far; exact from there
            while self.blocks[self.order[at]] * w < k * self.weights[self.order[at]]:  # ended before k / w
                at += 1
            slots = self.active[at] * k + self.gone[at] * w  # t(k / w) = slots / w
            releases.append(slots // w)
            deadlines.append(-(-slots // w))
        return releases[:-1], deadlines[1:]

    def slot_of_share(self, least: float) -> int | None:
        """The first slot from which less than ``least`` of the weight is active, if any."""
        whole = self.active[0] if self.active else 0
        for s, end, active, gone in zip(self.order, self.ends, self.active, self.gone):
            if active - self.weights[s] * self.times[s] < (least - 1e-9) * whole:
                return math.ceil(active * end + gone)
        return None


def pfair_slots(blocks: dict, weights: dict) -> dict:
    """The slot of each block of each source, earliest deadline first among released blocks."""
    fluid = Fluid(blocks, weights)
    window = {s: fluid.windows(s) for s in fluid.order}
    waiting = [(window[s][0][0], i, 0) for i, s in enumerate(fluid.order)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: dict = {s: [] for s in fluid.order}
    for t in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window[fluid.order[i]][1][k], i, k))
        _, i, k = heapq.heappop(ready)
        s = fluid.order[i]
        slots[s].append(t)
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (window[s][0][k + 1], i, k + 1))
    return slots


def block_windows(fluid: Fluid):
    """For ``mapInPandas``: spans of blocks (s, blocks, w, first) to blocks with release r, deadline d and the rank e of the source's end."""
    rank, ends = {}, -1
    for i, c in enumerate(fluid.order):
        ends += i == 0 or fluid.ends[i] != fluid.ends[i - 1]
        rank[c] = ends

    def table(rows: list) -> pd.DataFrame:
        each = [len(r[3]) for r in rows]
        long = lambda lists: np.concatenate([np.asarray(v, dtype=np.int64) for v in lists])
        return pd.DataFrame({
            "s": np.repeat(np.array([r[0] for r in rows], dtype=object), each), "k": long(range(r[2], r[2] + len(r[3])) for r in rows),
            "r": long(r[3] for r in rows), "d": long(r[4] for r in rows), "e": np.repeat(np.array([rank[r[1]] for r in rows], dtype=np.int64), each),
            "w": np.repeat(np.array([r[1][1] for r in rows], dtype=float), each)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held, known = [], 0, {}
            for s, blocks, w, first in batch.itertuples(index=False):
                if (blocks, w, first) not in known:
                    known[blocks, w, first] = fluid.windows((blocks, w), first, min(first + SPAN, blocks))
                rows.append((s, (blocks, w), first, *known[blocks, w, first]))
                held += len(rows[-1][3])
                if held >= 16 * SPAN:
                    yield table(rows)
                    rows, held, known = [], 0, {}
            if rows:
                yield table(rows)

    return run


def chunk_bounds(held: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(group, chunk, first, last): in which chunks the blocks of a group of priority that are released in a chunk may be placed.

    ``held`` counts blocks by group (the most urgent first) and chunk of
    release; ``starts`` holds the chunks' first slots and the end.  Both bounds
    are certain: a group gets nothing in a chunk while the groups before it have
    enough waiting for the whole chunk, and what is released before a chunk is
    placed once it and the groups before have, even at their latest, run out of
    blocks at some slot since.
    """
    groups, chunks = held.shape
    released = np.zeros((groups, chunks + 1), dtype=np.int64)
    released[:, 1:] = held.cumsum(axis=0).cumsum(axis=1)
    surplus = released - starts
    waiting = surplus - np.minimum.accumulate(surplus, axis=1)  # at the start of a chunk, at least
    free = np.ones((groups, chunks), dtype=bool)
    free[1:] = waiting[:-1, :-1] < np.diff(starts)
    first = np.minimum.accumulate(np.where(free, np.arange(chunks), chunks)[:, ::-1], axis=1)[:, ::-1]
    latest = np.minimum.accumulate(released[:, :-1] - starts[1:], axis=1)  # placed by a chunk's end less that slot, at least
    out = []
    for g, c in np.argwhere(held).tolist():
        through = surplus[g, c + 1:] <= latest[g, c]
        out.append((g, c, int(first[g, c]), c + int(through.argmax()) if through.any() else chunks - 1))
    return out


def chunked_slots(spark: SparkSession, sources: DataFrame, fluid: Fluid, chunk_blocks: int) -> DataFrame:
    """The slots of ``pfair_slots`` as a table (s, k, w, slot), found chunk by chunk of slots in tasks.

    ``sources`` has s, blocks and w; ``fluid`` has one entry for each (blocks, w).
    Blocks go by deadline, then by their source's end and name.
    """
    total = sum(b * fluid.times[c] for c, b in fluid.blocks.items())
    length = max(chunk_blocks, -(-total // MOST_CHUNKS))
    chunks = -(-total // length)
    starts = np.minimum(np.arange(chunks + 1, dtype=np.int64) * length, total)
    stage = SharedStage(spark, "mix-slots")
    spans = sources.select("s", "blocks", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(SPAN).cast("long"))).alias("first"))
    blocks = spans.repartition(chunks).mapInPandas(block_windows(fluid), "s string, k long, r long, d long, e long, w double")
    blocks = stage.put(blocks, "blocks")
    grouped = blocks.repartitionByRange(chunks, "d", "e", "s").withColumn("g", F.spark_partition_id())  # about `length` blocks in a group
    grouped = stage.put(grouped.withColumn("c", F.expr(f"r div {length}L")), "groups")
    stage.drop(blocks)
    cells = grouped.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")).toPandas()  # MOST_CHUNKS squared at most
    held = np.zeros((int(cells["g"].max()) + 1, chunks), dtype=np.int64)
    held[cells["g"], cells["c"]] = cells["n"]
    bounds = spark.createDataFrame(chunk_bounds(held, starts), "g int, c long, first long, last long")
    placing = grouped.join(F.broadcast(bounds), ["g", "c"]).select(
        "s", "k", "r", "d", "e", "w", "first", F.least("last", F.expr(f"(d - 1) div {length}L")).alias("last"))
    gone = np.zeros(chunks + 1, dtype=np.int64)
    for r in placing.groupBy("last").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per chunk
        gone[r["last"] + 1] = r["n"]
    early = starts - gone.cumsum()  # blocks that may still be waiting at a chunk's start, but are not

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        """One chunk; ``before`` is what it last started from, ``now`` what the chunk before says (null in the first round)."""
        c = int(rows["c"].iloc[0])
        rows = rows.sort_values(["d", "e", "s"], ignore_index=True)
        if rows["now"].isna().all():
            old = (rows["first"] < c).to_numpy()
            now = old & (old.cumsum() <= early[c])
        else:
            now = rows["now"].to_numpy(dtype=bool)
            if (now == rows["before"].to_numpy(dtype=bool)).all():
                return rows.assign(moved=False)
        release, slots = rows["r"].to_numpy(), np.full(len(rows), -1, dtype=np.int64)
        waiting = np.flatnonzero(~now)
        waiting = waiting[np.argsort(release[waiting], kind="stable")]
        times, waiting, at, ready = release[waiting].tolist(), waiting.tolist(), 0, []
        for t in range(int(starts[c]), int(starts[c + 1])):
            while at < len(times) and times[at] <= t:
                heapq.heappush(ready, waiting[at])
                at += 1
            if ready:
                slots[heapq.heappop(ready)] = t
        return rows.assign(before=now, slot=slots, moved=True)

    shape = "s string, k long, r long, d long, e long, w double, first long, c long, before boolean, slot long, now boolean, moved boolean"
    columns = [x.split()[0] for x in shape.split(", ")]
    state = placing.withColumn("c", F.explode(F.sequence("first", "last"))).withColumns({
        "before": F.lit(None).cast("boolean"), "slot": F.lit(-1).cast("long"), "now": F.lit(None).cast("boolean"), "moved": F.lit(True)})
    state = stage.put(state.select(columns).repartition(chunks, "c").groupBy("c").applyInPandas(place, shape), "round")
    stage.drop(grouped)
    past = Window.partitionBy("s", "k").orderBy("c")
    while not state.where("moved").isEmpty():
        told = state.withColumn("now", F.lag(F.col("before") | (F.col("slot") >= 0), 1, False).over(past))
        after = stage.put(told.select(columns).repartition(chunks, "c").groupBy("c").applyInPandas(place, shape), "round")
        stage.drop(state)
        state = after
    return state.where("slot >= 0").select("s", "k", "w", "slot")


def mix_sources(
    df: DataFrame, key_cols: list[str], source_col: str = "source", weights: dict[str | None, float] | None = None, power: float = 0.8,
    block_rows: int = 16, least_active: float = 0.9, seed: int = 23, buckets: int = 64, most_blocks: int | None = None, most_sources: int = 1 << 16,
    driver_blocks: int = 1 << 18, chunk_blocks: int = 1 << 16,
) -> DataFrame:
    """All rows and columns of ``df``, with ``mix_weight``, ``mix_block``, ``mix_slot``, ``mix_order`` and ``in_mix``.

    ``weights`` maps sources to target weights (None is the null source, which
    is another than the empty string); sources not named get none and are
    outside the mix.  Without it, a source of n rows weighs n ** ``power``.
    ``mix_weight`` is the source's share of all weights, ``mix_block`` the
    block's number in its source, ``mix_slot`` its slot, ``mix_order`` slot *
    rows of a block + the row's place in the block.  ``in_mix`` holds while the
    sources not yet used up have ``least_active`` of the weight; what is left is
    mixed on in the same way, so no row goes.  There may be any number of
    sources.  ``key_cols`` settle the random order inside a source; null keys are
    a value, rows equal in all keys may swap places.  Texts are not read.
    A block has ``block_rows`` rows; only if ``most_blocks`` is given, blocks are
    larger where there would be more than about so many.  Beyond ``most_sources``
    sources or ``driver_blocks`` blocks the schedule is found in tasks, in chunks
    of ``chunk_blocks`` slots; none of these three changes a result.
    Existing columns of the new names are replaced, no other column is touched;
    an empty table gives an empty result.
    """
    spark = df.sparkSession
    new = ["mix_weight", "mix_block", "mix_slot", "mix_order", "in_mix"]
    df = df.drop(*new)
    source, number, weight, slots, slot_at = free_names(df, "__s", "__n", "__w", "__slots", "__slot")
    named = F.col(source_col).cast("string")
    df = df.withColumn(source, F.when(named.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), named)))
    counts = df.groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(power)))
    else:
        rows = json.dumps([{"s": "n" if s is None else f"v{s}", "w": float(w)} for s, w in weights.items()])
        given = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<s:string,w:double>>")).alias("g")).select("g.*")
        weighed = counts.join(F.broadcast(given), "s", "left")  # as large as the argument
    weighed = SharedStage(spark, "mix").put(weighed.where("w > 0"), "sources")
    whole = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("sources")).first()
    if most_blocks:
        block_rows = max(block_rows, -(-(whole["n"] or 0) // most_blocks))
    weighed, total = weighed.withColumn("blocks", F.ceil(F.col("n") / block_rows)), whole["w"] or 1.0
    numbered = gapless_number(df, [source], F.xxhash64(F.lit(seed), *key_cols), number, buckets, ties=tuple(key_cols)).withColumn("mix_block", F.floor(F.col(number) / block_rows))
    if whole["sources"] <= most_sources and (whole["n"] or 0) // block_rows + whole["sources"] <= driver_blocks:
        each = {r["s"]: r for r in weighed.collect()}  # `most_sources` rows at most
        blocks, target = {s: r["blocks"] for s, r in each.items()}, {s: r["w"] for s, r in each.items()}
        exact = whole_weights(target) if target else {}
        fluid = Fluid(blocks, exact)
        rows = [{source: s, weight: target[s] / total, slots: at} for s, at in pfair_slots(blocks, exact).items()]
        table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{source}:string,{weight}:double,{slots}:array<bigint>>>")).alias("d")).select("d.*")
        found = numbered.join(F.broadcast(table), source, "left")  # most_sources rows and driver_blocks numbers at most
        slot = F.element_at(slots, (F.col("mix_block") + 1).cast("int"))
    else:
        classes = {(r["blocks"], r["w"]): r["n"] for r in weighed.groupBy("blocks", "w").agg(F.count(F.lit(1)).alias("n")).collect()}
        exact = whole_weights({w: w for _, w in classes})
        fluid = Fluid({c: c[0] for c in classes}, {c: exact[c[1]] for c in classes}, classes)
        placed = chunked_slots(spark, weighed, fluid, chunk_blocks)
        found = numbered.join(placed.select(F.col("s").alias(source), F.col("k").alias("mix_block"), (F.col("w") / total).alias(weight), F.col("slot").alias(slot_at)), [source, "mix_block"], "left")
        slot = F.col(slot_at)
    cut = fluid.slot_of_share(least_active)
    mixed = F.col(weight).isNotNull()
    return found.select(
        *[c for c in df.columns if c != source],
        F.coalesce(F.col(weight), F.lit(0.0)).alias("mix_weight"),
        F.when(mixed, F.col("mix_block")).alias("mix_block"),
        slot.alias("mix_slot"), (slot * block_rows + F.pmod(F.col(number), F.lit(block_rows))).alias("mix_order"),
        (mixed & (slot < F.lit(cut) if cut is not None else F.lit(True))).alias("in_mix"))
