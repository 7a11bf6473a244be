"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Texts arrive as Arrow batches inside Spark tasks. Everything below works on
whole texts; a text is never cut, only grouped with others into slabs whose
bytes are bounded, so that temporary arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 2 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)

#: white space between words: blank and \x09-\x0D
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A"):ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown on demand."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def slabs(column: pa.Array, size: int = SLAB_BYTES,
          ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``size`` bytes.

    Yields first row, row after the last, the UTF-8 bytes of the run and the
    byte offsets of its rows. Null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, bytes_[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def words(text: np.ndarray, rows: np.ndarray, separator: np.ndarray = _SEPARATOR):
    """Hashes of the lower-cased words of a slab, the runs between separator bytes.

    Returns the word hashes, the byte position of each word's start and end,
    and for each row the index of its first word (one more entry at the end).
    """
    n = len(text)
    if not n:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, np.zeros(len(rows), np.int64)
    inside = ~separator[text]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[rows] = True
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = _spans(_LOWER[text], starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, rows, side="left")


def lines(text: np.ndarray, rows: np.ndarray):
    """Hashes of the lines of a slab, byte by byte, without their newlines.

    Returns the same as ``words``; every row has one line more than newlines.
    """
    breaks = np.flatnonzero(text == 0x0A)
    ends = np.concatenate([rows[1:], breaks])
    # a break where a row ends is the first byte of a later row, so it comes after
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    last = order < len(rows) - 1
    starts = np.empty(len(ends), dtype=np.int64)
    starts[0:1] = 0
    starts[1:] = np.where(last[:-1], ends[:-1], ends[:-1] + 1)
    first = np.append(0, np.flatnonzero(last) + 1)
    return _spans(text.astype(np.uint64), starts, ends), starts, ends, first


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte spans, from one running sum, then mixed."""
    up, down = _power_table(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values + _U(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]
               + (ends - starts).astype(np.uint64) * _ODD)


def fold(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(word_hashes[:n] + _U(size * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
    for j in range(1, size):
        out = mix(out * _ODD + word_hashes[j:j + n])
    return out


def shingles(word_hashes: np.ndarray, first: np.ndarray, size: int):
    """Hashes of the word shingles of each row, and the row each belongs to.

    A row of fewer than ``size`` words has its whole sequence as one shingle,
    a row without words has none. Repeated shingles are not removed here.
    """
    counts = np.diff(first)
    own = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), own)
    start = np.repeat(first[:-1], own) + ramp(own)
    out = np.zeros(len(row), dtype=np.uint64)
    length = np.minimum(counts, size)[row]
    for n in range(1, size + 1):
        at = np.flatnonzero(length == n)
        if len(at):
            out[at] = fold(word_hashes, n)[start[at]]
    return out, row


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive groups of the given sizes."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row of a string column."""
    for first, last, text, rows in slabs(column):
        hashes, _, _, begin = words(text, rows)
        found, row = shingles(hashes, begin, size)
        cuts = np.searchsorted(row, np.arange(last - first + 1))
        for i in range(last - first):
            yield np.unique(found[cuts[i]:cuts[i + 1]])
