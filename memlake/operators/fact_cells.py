"""Facts against queries in the cells of ``orchestrate.fact_adjustment``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Truth values (of a fact, or a stem of its value, and a query) that are looked at at once.
AT_ONCE = 1 << 20
BOOST, DEMOTE = 0.25, 0.15


def adjust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(query_id, id, boost, demote)`` for each match that counts, of a partition's whole cells."""
    held = list(batches)
    if held:
        rows = pa.Table.from_batches(held)
        for cell in rows["cell"].unique():
            yield from _adjust_cell(rows.filter(pc.equal(rows["cell"], cell)))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All values of lists, their lengths, and where each begins."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), lengths, np.cumsum(lengths) - lengths


def _bits(words: pa.Array, column: pa.Array) -> np.ndarray:
    """A row of bits for each word: which lists of ``column`` hold it."""
    values, lengths, _ = _lists(column)
    word, row = pc.index_in(values, value_set=words).fill_null(-1).to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
    word, row = word[word >= 0].astype(np.int64), row[word >= 0]
    wide = -(-len(lengths) // 8)
    bits = np.zeros(len(words) * wide, np.uint8)
    np.bitwise_or.at(bits, word * wide + (row >> 3), (128 >> (row & 7)).astype(np.uint8))
    return bits.reshape(len(words), wide)


def _firsts(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _adjust_cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    facts, asked = (rows.filter(pc.equal(rows["fact"], kind)) for kind in (True, False))
    if not facts.num_rows or not asked.num_rows:
        return
    one = lambda t, c: t[c].combine_chunks()
    # Facts by subject, without those of subjects that have no current one.
    code, on = one(facts, "subject").dictionary_encode().indices.to_numpy(), one(facts, "flag").to_numpy(zero_copy_only=False)
    n = np.bincount(code, on).astype(np.int64)
    order = np.argsort(code, kind="stable")
    order = order[n[code[order]] > 0]
    if not len(order):
        return
    facts, code, on = facts.take(order), code[order], on[order]
    first = _firsts(code)
    n, of = n[code[first]], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))
    # Queries by id; ``twins``: some share one.
    code = one(asked, "query_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.argsort(code, kind="stable")
    asked, same = asked.take(order), _firsts(code[order])
    asks, width = one(asked, "flag").to_numpy(zero_copy_only=False), asked.num_rows
    twins, alike = len(same) < width, np.diff(np.r_[same, width])
    # Bits of the words of subjects, and of the stems of facts that have current rivals.
    words, n_words, word_at = _lists(one(facts, "words").take(first))
    words = words.dictionary_encode()
    word, has_word = words.indices.to_numpy(), _bits(words.dictionary, one(asked, "words"))
    rivals = on & (twins | (n[of] > 1))
    stems, n_stems, stem_at = (np.zeros(len(of), np.int64) for _ in range(3))
    stems, n_stems[rivals], stem_at[rivals] = _lists(one(facts, "stems").filter(rivals))
    stems = stems.dictionary_encode()
    stem, has_stem = stems.indices.to_numpy(), _bits(stems.dictionary, one(asked, "stems"))

    weight = np.r_[0, np.cumsum(1 + n_stems)][np.r_[first, len(of)]]  # of the subjects before
    ids, query_ids, low = one(facts, "id"), one(asked, "query_id"), 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(weight, weight[low] + AT_ONCE // width, "right")) - 1)
        step = width if twins else max(8, AT_ONCE // int(weight[high] - weight[low]) // 8 * 8)
        for begin in range(0, width, step):
            end = min(width, begin + step)
            part = slice(begin // 8, -(-end // 8))
            open_bits = lambda bits: np.unpackbits(bits, axis=1, count=end - begin)  # noqa: B023, E731
            hit = has_word[word[word_at[low:high]], part]
            for k in range(1, n_words[low:high].max()):
                more = np.flatnonzero(n_words[low:high] > k)
                hit[more] &= has_word[word[word_at[low + more] + k], part]
            at = np.arange(first[low], first[high] if high < len(first) else len(of))
            at = at[hit.any(axis=1)[of[at] - low]]
            if not len(at):
                continue
            counts = open_bits(hit[of[at] - low]).view(bool)
            counts[~on[at]] &= asks[begin:end]
            race = np.flatnonzero(rivals[at])
            if len(race):
                runs, size = at[race], n_stems[at[race]]
                shared = np.zeros((len(race), end - begin), np.uint16 if size.max() < 1 << 16 else np.uint32)
                for k in range(size.max()):
                    more = np.flatnonzero(size > k)
                    shared[more] += open_bits(has_stem[stem[stem_at[runs[more]] + k], part])
                shared *= counts[race]
                lead = _firsts(of[runs])
                lane = np.repeat(np.arange(len(lead)), np.diff(np.r_[lead, len(runs)]))
                most, sole = np.maximum.reduceat(shared, lead, axis=0), np.zeros((len(lead), 1), bool)
                if twins:
                    most = np.repeat(np.maximum.reduceat(most, same, axis=1), alike, axis=1)
                    times = np.add.reduceat(counts[race[lead]].astype(np.int64), same, axis=1)
                    sole = np.repeat(times * n[of[runs[lead]]][:, None] == 1, alike, axis=1)
                counts[race] &= sole[lane] | ((shared > 0) & (shared == most[lane]))
            found, query = np.divmod(np.flatnonzero(counts), end - begin)
            if len(found):
                now = on[at[found]]
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(query + begin)), ids.take(pa.array(at[found])), pa.array(np.where(now, BOOST, 0.0)), pa.array(np.where(now, 0.0, DEMOTE))], ["query_id", "id", "boost", "demote"])
        low = high
