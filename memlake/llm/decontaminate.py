"""Benchmark decontamination by SimHash windows (operator 4).

A passage at similarity ``LEAST`` can lack up to a fifth of an item's shingles
at its ends.  So an item of n words lends the size of a window: the largest of a
ladder of sizes that is at least three words shorter than the shortest run of
its words that still counts.  Documents are read in windows of each size, one
every four words (items under twelve words: one at every word), and an item
gives a fingerprint for each of its offsets, so a copied run always meets one
window that holds the same words.  Fingerprints are 64-bit SimHashes of the
window's word pairs.  They are looked up in four tables of 16-bit blocks: two
fingerprints within 11 bits agree to 2 bits in one block at least, so looking up
all block values within 2 bits finds every fingerprint within the radius.  Each
hit is then confirmed by the exact weighted similarity of the item's 5-word
shingles and those of the passages around it, of the item's length and shorter
or longer ones: shingles that fewer items of the whole benchmark have weigh more.

Words are runs of letters and digits, A-Z lower-cased; where a script puts no
spaces between words (Han, kana, Thai, Lao, Khmer, Burmese), each letter is one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import textvec as tv
from memlake.plans.names import free_names
from memlake.plans.shared import SharedStage

U64 = np.uint64
STRIDE = 4
RADIUS = 11
LEAST = 0.8
#: Words of a slice that are compared at once.
STEP_WORDS = 1 << 18
#: All 16-bit values with at most two bits set.
NEAR = np.array([0, *[1 << i for i in range(16)], *[(1 << i) | (1 << j) for i, j in combinations(range(16), 2)]], np.uint16)


def words_of(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, of_row) of lower-cased UTF-8 texts."""
    if not len(part) or part.max() < 0xE0:
        starts, ends, of_row = tv.tokens(part, offsets, tv.ALNUM)
        return tv.word_hashes(part, starts, ends), of_row
    inside, cuts = tv.ALNUM[part], np.zeros(len(part) + 1, bool)
    lead = np.flatnonzero(part >= 0xE0)
    first, second, third = part[lead], part[np.minimum(lead + 1, len(part) - 1)], part[np.minimum(lead + 2, len(part) - 1)]
    wide_sign = (first == 0xEF) & ((second == 0xBC) & ((third < 0x90) | (third > 0x99) & (third < 0xA1) | (third > 0xBA)) | (second == 0xBD) & ((third < 0x81) | (third > 0x9A) & (third < 0xA6)))
    sign = lead[(first == 0xE2) & (second < 0xB0) | (first == 0xE3) & (second == 0x80) | wide_sign]
    for k in range(3):
        inside[np.minimum(sign + k, len(part) - 1)] = False
    alone = (first >= 0xE3) & (first <= 0xE9) | (first == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (first == 0xE1) & np.isin(second, (0x80, 0x81, 0x9E, 0x9F)) | (first == 0xF0) & (second >= 0xA0)
    for begin, width in ((lead[alone & (first < 0xF0)], 3), (lead[alone & (first == 0xF0)], 4)):
        cuts[begin] = True
        cuts[np.minimum(begin + width, len(part))] = True
    starts, ends, of_row = tv.tokens(part, offsets, inside=inside, cuts=cuts)
    return tv.word_hashes(part, starts, ends), of_row


def ladder(longest: int) -> list[int]:
    """Window sizes: 8, 10, 12, then about a fifth larger each time."""
    sizes = [8, 10, 12]
    while sizes[-1] < longest:
        sizes.append(sizes[-1] + max(3, sizes[-1] // 5))
    return sizes


def slack(words: int, shingle: int, least: float) -> int:
    """How many words an item may lack at its ends, if all shingles weigh the same."""
    return int((1 - least) * max(words - shingle + 1, 0) + 1e-9)


def window_of(words: int, sizes: list[int], shingle: int = 5, least: float = LEAST) -> tuple[int, int]:
    """(window size, stride) for an item."""
    run = words - slack(words, shingle, least)
    return (max(s for s in sizes if s <= run - (STRIDE - 1)), STRIDE) if run >= sizes[0] + STRIDE - 1 else (run, 1)


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash for each word and the next."""
    with np.errstate(over="ignore"):
        after = np.zeros_like(words)
        after[:-1] = words[1:]
        return tv.mix(words * U64(0x9E3779B97F4A7C15) + after)


class Windows:
    """SimHashes of the windows of a run of words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.words = words
        features = _pairs(words)
        kind = np.uint8 if longest <= 250 else np.uint16 if longest <= 65_000 else np.uint32  # counts wrap, differences do not
        self.sums = np.zeros((len(features) + 1, 64), kind)
        np.cumsum(np.unpackbits(features.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=kind, out=self.sums[1:])

    def marks(self, at: np.ndarray, size: int) -> np.ndarray:
        """The SimHash of the ``size`` words from each position on: of their pairs, or of one word alone."""
        if size == 1:
            return tv.mix(self.words[at])
        ones = self.sums[at + (size - 1)] - self.sums[at]
        return np.packbits(ones > (size - 1) // 2, axis=1, bitorder="little").view("<u8").ravel()


class Benchmark:
    """Items ready for lookup: shingles with their weights, and per (size, stride) the block tables.

    ``counts`` tells for each item how many of all ``total`` items have each of
    its shingles: (shingle, items) pairs.
    """

    def __init__(self, ids: list, texts: list[str], counts: list[list[tuple[int, int]]], total: int, shingle: int, least: float):
        data, offsets = tv.utf8(pa.array(texts, pa.string()))
        words, of_row = words_of(tv.LOWER[data], offsets)
        self.ids, self.shingle, self.least = ids, shingle, least
        self.rare = math.log1p(total)
        self.own, self.weight, self.whole = [], [], []
        for pairs in counts:
            own = np.array([s for s, _ in pairs], np.int64).view(U64)
            weight = np.log1p(total / np.array([c for _, c in pairs], np.float64))
            order = np.argsort(own)
            self.own.append(own[order])
            self.weight.append(weight[order])
            self.whole.append(float(weight.sum()))
        self.sizes = np.diff(of_row)
        self.longest = int(self.sizes.max(initial=0))
        steps = ladder(self.longest)
        groups: dict[tuple[int, int], list[int]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            if n:
                groups.setdefault(window_of(n, steps, shingle, least), []).append(i)
        self.tables = {}
        windows = Windows(words, self.longest) if groups else None
        for (size, stride), members in groups.items():
            item = np.concatenate([np.full(self.sizes[i] - size + 1, i) for i in members])
            offset = np.concatenate([np.arange(self.sizes[i] - size + 1) for i in members])
            marks = windows.marks(of_row[item] + offset, size)
            blocks = []
            for b in range(4):
                value = ((marks >> U64(16 * b)) & U64(0xFFFF)).astype(np.uint16)
                near = (value[:, None] ^ NEAR[None, :]).ravel()
                order = np.argsort(near, kind="stable")
                blocks.append((np.searchsorted(near[order], np.arange(65537)), (order // len(NEAR)).astype(np.int32)))
            self.tables[size, stride] = item, offset, marks, blocks

    def _shares(self, item: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each shingle: its weight if the item has it, and its weight if not."""
        own = self.own[item]
        at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
        mine = own[at] == grams
        return np.where(mine, self.weight[item][at], 0.0), np.where(mine, 0.0, self.rare)

    def best_passage(self, item: int, words: np.ndarray, low: int, high: int, start: int) -> tuple[float, int, int]:
        """(similarity, first word, end) of the best passage about ``start`` inside words low .. high."""
        n, size = int(self.sizes[item]), self.shingle
        if n < size:  # one shingle, of all its words
            if start < low or start + n > high:
                return 0.0, start, start
            gram, _ = tv.shingles(words[start : start + n], np.array([0, n]), size)
            return float(gram[0] == self.own[item][0]), start, start + n
        spare = slack(n, size, self.least) + 2
        a, z = max(low, start - spare), min(high, start + n + spare)
        if z - a < size:
            return 0.0, start, start
        grams, _ = tv.shingles(words[a:z], np.array([0, z - a]), size)
        begins = np.arange(a, max(a, min(start + spare, z - size)) + 1)
        ends = np.arange(max(a + size, start + n - spare), z + 1)
        if not len(ends):
            return 0.0, start, start
        has, lacks = (np.concatenate([[0.0], np.cumsum(x)]) for x in self._shares(item, grams))
        last = np.maximum(ends - a - size + 1, 0)[None, :]
        first = np.minimum((begins - a)[:, None], last)
        share = (has[last] - has[first]) / (self.whole[item] + lacks[last] - lacks[first])
        if len(np.unique(grams)) < len(grams):  # repeats count once: settle each passage by its set
            for x, y in zip(*np.nonzero(share > 0)):
                mine, other = self._shares(item, np.unique(grams[first[x, 0] : last[0, y]]))
                share[x, y] = mine.sum() / (self.whole[item] + other.sum())
        x, y = divmod(int(np.argmax(share - 1e-12 * ends[None, :])), share.shape[1])
        return float(share[x, y]), int(begins[x]), int(ends[y])

    def matches(self, words: np.ndarray, of_row: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row, item) -> (best similarity, first word of the passage, its words)."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        if not self.tables:
            return best
        for base in range(0, len(words), STEP_WORDS):
            self._step(words, of_row, base, best)
        return best

    def _step(self, words: np.ndarray, of_row: np.ndarray, base: int, best: dict) -> None:
        """The windows that start at ``base`` and up to STEP_WORDS on."""
        seen_to = min(base + STEP_WORDS + self.longest, len(words))
        windows = Windows(words[base:seen_to], self.longest)
        spot = np.arange(base, min(base + STEP_WORDS, len(words)))
        row = np.searchsorted(of_row, spot, side="right") - 1
        inside, room = spot - of_row[row], of_row[row + 1] - spot
        asked: set[tuple[int, int, int]] = set()
        for (size, stride), (item, offset, marks, blocks) in self.tables.items():
            at = np.flatnonzero((inside % stride == 0) & (room >= size))
            if not len(at):
                continue
            seen = windows.marks(at, size)
            for b, (begin, entry) in enumerate(blocks):
                value = ((seen >> U64(16 * b)) & U64(0xFFFF)).astype(np.int64)
                low, n = begin[value], begin[value + 1] - begin[value]
                hit = np.repeat(np.arange(len(at)), n)
                take = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                known = entry[take]
                near = np.bitwise_count(seen[hit] ^ marks[known]) <= RADIUS
                where, which = at[hit[near]], known[near]
                asked.update(zip(row[where].tolist(), item[which].tolist(), (spot[where] - offset[which]).tolist()))
        for r, i, s in sorted(asked):
            low = int(of_row[r])
            share, first, end = self.best_passage(i, words, low, int(of_row[r + 1]), s)
            old = best.get((r, i), (0.0, 0, 0))
            if share >= self.least and (share > old[0] or share == old[0] and first - low < old[1]):
                best[r, i] = share, first - low, end - first


def _grams(shingle: int):
    """Each item's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tv.utf8(batch.column("text"))
            words, of_row = words_of(tv.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0])
            values, cut = tv.distinct(*tv.shingles(words, of_row, shingle))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(values.view(np.int64)))], ["id", "text", "grams"])

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, shingle: int, block_bytes: int) -> Iterator[tuple]:
    """The benchmark in parts of about ``block_bytes`` of text: ids, texts, shingle counts over all items; number of items."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    cut = items.mapInArrow(_grams(shingle), "id long, text string, grams array<long>")
    each = cut.withColumn("key", F.sha2("text", 256)).select("id", "key", F.explode("grams").alias("s"))
    counts = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    pairs = each.join(counts, "s").groupBy(F.col("id").alias("own"), "key").agg(F.collect_list(F.struct("s", "c")).alias("pairs"))
    joined = items.join(pairs, F.col("id").eqNullSafe(F.col("own")) & (F.sha2("text", 256) == F.col("key")))
    known = SharedStage(benchmark.sparkSession, "benchmark").put(joined.select("id", "text", "pairs"), "items")
    total, size = known.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = -(-(size or 0) // block_bytes)
    for p in range(parts):
        rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).orderBy("id", "text").collect()  # about block_bytes
        if rows:
            yield [r["id"] for r in rows], [r["text"] for r in rows], [[(x["s"], x["c"]) for x in r["pairs"]] for r in rows], total


_ready: dict[str, Benchmark] = {}


def _index(name: str, block: tuple, shingle: int, least: float) -> Benchmark:
    """The index of a block, built once in a Python worker; the last few stay."""
    if name not in _ready:
        while len(_ready) >= 4:
            _ready.pop(next(iter(_ready)))
        _ready[name] = Benchmark(*block, shingle, least)
    return _ready[name]


def _each_slice(batch: pa.RecordBatch, column: str, items: Benchmark) -> Iterator[tuple[int, int, dict]]:
    data, offsets = tv.utf8(batch.column(column))
    for low, high in tv.slices(offsets):
        words, of_row = words_of(tv.LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low])
        yield low, high, items.matches(words, of_row)


def _find(block: tuple, shingle: int, least: float) -> Callable:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _index(name, block, shingle, least)
        for batch in batches:
            for low, _, found in _each_slice(batch, "text", items):
                if found:
                    keys = sorted(found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array([low + r for r, _ in keys])), pa.array([items.ids[i] for _, i in keys], pa.int64()),
                         *[pa.array([found[k][c] for k in keys], kind) for c, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]],
                        ["doc_id", "item_id", "similarity", "first_word", "words"])

    return run


def _drop(column: str, block: tuple, shingle: int, least: float) -> Callable:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _index(name, block, shingle, least)
        for batch in batches:
            clean = np.ones(len(batch), bool)
            for low, _, found in _each_slice(batch, column, items):
                clean[[low + r for r, _ in found]] = False
            yield batch.filter(pa.array(clean)).select(batch.schema.names[:-1])

    return run


def contaminated_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shingle: int = 5, least: float = LEAST, block_bytes: int = 4 << 20,
) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, words)`` for each item that a document holds, its best passage.

    The best passage is the one of highest similarity; of equal ones the first,
    then the shortest.  Items of fewer than ``shingle`` words must be there as
    they are.  Null, empty and wordless texts match nothing; each repeated
    document gives its rows, an item repeated in id and text counts once, null
    ids pass through.  Texts of any length are read whole, some 260,000 words at
    a time.  Other columns are not read, so their names cannot clash; an empty
    table on either side gives an empty result.  The benchmark is handled in
    blocks of ``block_bytes``, each against all rows in a pass of its own;
    weights count all items, so the blocks do not show in the result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shape = "doc_id long, item_id long, similarity double, first_word long, words long"
    out = docs.sparkSession.createDataFrame([], shape)
    for block in _blocks(benchmark, item_col, item_text, shingle, block_bytes):
        out = out.unionByName(base.mapInArrow(_find(block, shingle, least), shape))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, least: float = LEAST, block_bytes: int = 4 << 20,
) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that hold no benchmark item; no document is shuffled.

    Cases are as in ``contaminated_passages``; repeated rows stay or go together.
    """
    (column,) = free_names(docs, "__text")
    for block in _blocks(benchmark, item_col, item_text, shingle, block_bytes):
        docs = docs.withColumn(column, F.col(text_col).cast("string")).mapInArrow(_drop(column, block, shingle, least), docs.schema)
    return docs
