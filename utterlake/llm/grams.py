"""Words and runs of words of Arrow text columns as NumPy arrays; runs inside Python workers.

A word is a run of bytes other than the space and the controls 9 to 13; in UTF-8 no longer character
holds such bytes. Words are hashed by a table of random numbers and powers of an odd multiplier, runs
of words by prefix sums, all modulo 2**64, so any run costs the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of each number spread over the whole word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    if lower:
        codes[65:91] = codes[97:123]
    codes[_BLANK] = 0
    return codes


class Words:
    """Words of a text column, ``blank`` telling which bytes part words: ``start``, ``end`` (bytes), ``first`` (word number of each row's first word, with an end)."""

    def __init__(self, column, blank: np.ndarray = _BLANK) -> None:
        self.blank = blank
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]
        inside = ~blank[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.at[(self.at > 0) & (self.at < len(self.data))]
        before[edges], after[edges - 1] = False, False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.counts = np.diff(self.first)
        self.rows = len(self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, lower: bool = False, step: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word; A-Z count as a-z if ``lower``."""
        codes, out = _byte_codes(lower), np.zeros(len(self), np.uint64)
        longest = int((self.end - self.start).max(initial=0))
        powers = _powers(0x2545F4914F6CDD1D, longest + 1)
        low = 0
        while low < len(self):
            high = max(low + 1, int(np.searchsorted(self.end, self.start[low] + step)))
            begin, lengths = self.start[low:high], (self.end - self.start)[low:high]
            place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            values = codes[self.data[np.repeat(begin, lengths) + place]] * powers[place]
            out[low:high] = np.add.reduceat(values, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)
            low = high
        return mix(out)

    def strings(self) -> pa.Array:
        """The words as one string array."""
        lengths = self.end - self.start
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(ends), pa.py_buffer(self.data[~self.blank[self.data]]))

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Kept words of each row, joined by one space."""
        kept = np.concatenate([[0], np.cumsum(keep)])[self.first]
        lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), self.strings().filter(pa.array(keep)).cast(pa.string()))
        return pc.binary_join(lists, " ")


def runs(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring values, across rows; ``len - size + 1`` of them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 5) % (1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, len(hashes)), dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * _powers(pow(base, -1, 1 << 64), n) + _U(seed))


def inside(words: Words, size: int) -> np.ndarray:
    """Which runs of ``size`` words lie in one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    row = words.row()
    return row[:n] == row[size - 1 :]
