"""Words, lines and shingles of whole Arrow batches as numpy arrays.

A word is a run of bytes other than space and \\t to \\r, so words never depend on a locale or a regex engine.
Work goes slice by slice: a slice is a run of rows of about `SLICE` bytes (one row, if that alone is longer), which
bounds the temporary arrays whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_TABLE = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs only give equal outputs, and every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64 random bits as a double in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _weights(at: np.ndarray) -> np.ndarray:
    """The weight of each byte position in a segment: no two positions share one by rule."""
    return mix(at.astype(_U) + _U(1)) | _U(1)


#: The weights of the first positions, which nearly all words and lines lie within.
_FIRST = _weights(np.arange(_TABLE))


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; segments don't overlap, are in order and may be empty."""
    lens = ends - starts
    out = np.zeros(len(starts), _U)
    full = np.flatnonzero(lens)
    if len(full):
        n = lens[full]
        first = np.cumsum(n) - n
        local = np.arange(int(n.sum())) - np.repeat(first, n)
        values = data[np.repeat(starts[full], n) + local].astype(_U) + _U(1)
        values *= _FIRST[local] if n.max() <= _TABLE else _weights(local)
        out[full] = np.add.reduceat(values, first)
    return mix(out + lens.astype(_U) * _U(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of rows [lo, hi) of a column. row: each word's row less lo; offsets: of the rows in data."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def hashes(self) -> np.ndarray:
        return segment_hash(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row the mask marks."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


#: Every ASCII character but letters and digits: what parts words where punctuation and case don't count.
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 capitals made small."""
    out = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 32
    return out


def plain_slices(column: pa.Array, limit: int = SLICE) -> Iterator[Words]:
    """As slices(), but words are small-letter runs of letters, digits and non-ASCII characters."""
    return slices(column, limit, _PARTS, lowered)


def slices(column: pa.Array, limit: int = SLICE, space: np.ndarray = _SPACE, change=None) -> Iterator[Words]:
    """The words of a string column, null as empty, slice by slice."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offs, body = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        yield _words(change(part) if change else part, offsets[lo : hi + 1] - offsets[lo], lo, hi, space)
        lo = hi


def _words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, space: np.ndarray) -> Words:
    inside = ~space[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[at] = inside[at]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offsets[1:], starts, "right")
    return Words(lo, hi, data, offsets, starts, ends, row)


def shingles(words: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of `size` words of a row."""
    h = words.hashes() if hashes is None else hashes
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n, _U)
    for k in range(size):
        total += h[k : k + n] * _U((0xD1342543DE82EF95 * (2 * k + 1) + 2 * k) & (2**64 - 1) | 1)
    first = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return mix(total[first]), words.row[first], first


def shingle_bags(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts: (row, hash, count), by row.

    A row of 1 to size - 1 words has one shingle, all its words; a row without words has none.
    """
    h = words.hashes()
    hashes, rows, _ = shingles(words, size, h)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(words.row, short)
        extra = np.zeros(len(short), _U)
        for k in range(size - 1):
            here = counts[short] > k
            extra[here] += h[first[here] + k] * _U((0xA0761D6478BD642F * (2 * k + 1) + 2 * k) & (2**64 - 1) | 1)
        hashes, rows = np.concatenate([hashes, mix(extra)]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(hashes)))
