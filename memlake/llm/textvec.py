"""Whole-batch text work in numpy: tokens, word hashes and shingles of Arrow columns.

Everything works on the UTF-8 bytes of many texts at once; nothing loops over
words in Python.  ``slices`` cuts a batch so that the arrays of one step stay
within a few dozen MB, except where one single text is larger than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Bytes between words: space, tab, newline, vertical tab, form feed, return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACES
#: Letters and digits of ASCII, and every byte beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            base = np.full(max(n, 1 << 16), _ODD if kind == "up" else _ODD_INVERSE, U64)
            base[0] = 1
            _powers[kind] = have = np.cumprod(base)
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(rows, max(low + 1, high))
        yield low, high
        low = high


def tokens(
    data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_SPACE, inside: np.ndarray | None = None, cuts: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, of_row): maximal runs of ``keep`` bytes that stay inside a row.

    ``of_row[i] : of_row[i + 1]`` are the tokens of row i.  ``inside`` tells the
    bytes to keep one by one instead; a run also ends before each place that
    ``cuts`` (one longer than the data) marks.
    """
    inside = keep[data] if inside is None else inside
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[filled] = False
    if cuts is not None:
        before[cuts[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    after[last] = False
    if cuts is not None:
        after[cuts[1:]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each token."""
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[data] * _power("up", len(data)), out=total[1:])
        found = total[ends] - total[starts]
        found *= _power("down", len(data) + 1)[starts]
        return mix(found + (ends - starts).astype(U64) * U64(_ODD))


def shingles(words: np.ndarray, of_row: np.ndarray, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, of_row) of each row's runs of ``size`` words, repeats included.

    With ``whole``, a row of 1 to size - 1 words has its whole sequence as one.
    """
    counts = np.diff(of_row)
    n = len(words)
    with np.errstate(over="ignore"):
        at = np.repeat(of_row[1:], counts)  # where the row of each word ends
        full = np.flatnonzero(np.arange(n) + size <= at)
        value = words[full].copy()
        for j in range(1, size):
            value *= U64(_ODD)
            value += words[full + j]
        value = mix(value + U64(size))
        found = np.maximum(counts - size + 1, 0)
        if whole:
            short = np.flatnonzero((counts > 0) & (counts < size))
            if len(short):
                few = np.empty(len(short), U64)
                for i, row in enumerate(short):
                    low, high = of_row[row], of_row[row + 1]
                    v = words[low : low + 1].copy()
                    for j in range(low + 1, high):
                        v *= U64(_ODD)
                        v += words[j]
                    few[i] = mix(v + U64(high - low))[0]
                found[short] = 1
                before = np.concatenate([[0], np.cumsum(found)])
                out = np.empty(before[-1], U64)
                is_short = np.zeros(before[-1], bool)
                is_short[before[short]] = True
                out[is_short] = few
                out[~is_short] = value
                return out, before
        return value, np.concatenate([[0], np.cumsum(found)])


def distinct(values: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending."""
    values = values.copy()
    for low, high in zip(of_row[:-1].tolist(), of_row[1:].tolist()):
        values[low:high].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[of_row[:-1][of_row[:-1] < of_row[1:]]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], before[of_row]


def row_sums(values: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    """Sums of each row's values, modulo 2**64 for unsigned ones; 0 for an empty row."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
        return total[of_row[1:]] - total[of_row[:-1]]
