"""Whole texts to arrays of word hashes, a megabyte at a time, in NumPy.

A word's hash is a sum of table values times powers of an odd base, modulo 2**64, then mixed; one running sum gives
the hashes of all words of a block. Equal words have equal hashes in every process, and memory follows the block size and the longest word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each input bit sways all output bits."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
LOWER = TABLE.copy()
LOWER[65:91] = TABLE[97:123]


#: So many powers of a base are kept; more, for words or texts that no block can cut, are made anew each time.
_KEPT = BLOCK + 4096


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64."""
    have = _POWERS.get(base) if n <= _KEPT else None
    if have is None:
        have = np.full(max(n, _KEPT), base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= _KEPT:
            _POWERS[base] = have
    return have[:n]


def tidy() -> None:
    """Give memory that is free back to the system, as a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and where each row starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _block(data: np.ndarray, breaks: np.ndarray, table: np.ndarray, stops: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of the words in ``data``, then the hashes of their first so many bytes; words also end at ``breaks``."""
    n = len(data)
    letter = ~stops[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = ~letter[:-1]
    edge[breaks] = True
    starts = np.flatnonzero(letter & edge[:n])
    edge[:n] = ~letter
    edge[n] = True
    edge[breaks] = True
    ends = np.flatnonzero(letter & edge[1:]) + 1
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(table[data] * powers(_BASE, n), out=total[1:])
    back = powers(_INVERSE, n)[starts]
    out = [starts, ends]
    for size in (0, *heads):
        stop = np.minimum(ends, starts + size) if size else ends
        out.append(mix((total[stop] - total[starts]) * back + (stop - starts + size * (stop < ends)).astype(U) * U(0xA24BAED4963EE407)))
    return tuple(out)


def word_blocks(data: np.ndarray, at: np.ndarray, lower: bool = True, stops: np.ndarray = SPACE, heads: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, starts and ends of the words of all rows, a block of bytes after the other; no word is cut, a long row may be.

    The hashes are rows of a matrix: of the words, then of their first so many bytes for each of ``heads`` (of shorter words, the word's own).
    A word is a run of bytes outside ``stops`` (as default ``[^\\x20\\x09-\\x0D]+``) within a row. ``lower``: A-Z count as a-z.
    """
    table = LOWER if lower else TABLE
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:
            row = int(at[np.searchsorted(at, hi, "right") - 1])
            if row > lo:
                hi = row
            else:  # one long row: cut it after a stop
                end = int(at[np.searchsorted(at, lo, "right")])
                cut = np.flatnonzero(stops[data[lo:hi]])
                if len(cut):
                    hi = lo + int(cut[-1]) + 1
                while not len(cut) and hi < end:
                    first, hi = hi, min(end, hi + BLOCK)
                    cut = np.flatnonzero(stops[data[first:hi]])
                    if len(cut):
                        hi = first + int(cut[0]) + 1
        breaks = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi, "left")] - lo
        s, e, *h = _block(data[lo:hi], breaks, table, stops, heads)
        yield np.stack(h), s + lo, e + lo
        lo = hi


def word_spans(data: np.ndarray, at: np.ndarray, lower: bool = True, stops: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of all rows, and the number of words before each row."""
    hashes, starts, ends = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h, s, e in word_blocks(data, at, lower, stops):
        hashes.append(h[0])
        starts.append(s)
        ends.append(e)
    where = np.concatenate(starts)
    return np.concatenate(hashes), where, np.concatenate(ends), np.searchsorted(where, at, "left")


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True, stops: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the number of words before each row."""
    hashes, _, _, first = word_spans(data, at, lower, stops)
    return hashes, first


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a row of fewer words has its whole sequence as one, a row without words none."""
    words, first = word_hashes(data, at)
    n = len(words)
    whole = np.zeros(0, U)
    if n >= k:
        whole = words[: n - k + 1].copy()
        for j in range(1, k):
            whole *= U(0x9FB21C651E98DF25)
            whole += words[j : n - k + 1 + j]
        whole = mix(whole)
    out = []
    for i in range(len(at) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif b > a:
            s = np.array([b - a], dtype=U)
            for w in words[a:b]:
                s = mix(s * U(0x9FB21C651E98DF25) + w)
            out.append(s)
        else:
            out.append(whole[:0])
    return out


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 2048, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has at most so many rows and, but for single rows, bytes in a column. After the last, free memory goes back to the system."""
    for batch in batches:
        lo, n = 0, batch.num_rows
        if not n:
            continue
        sizes = np.diff(utf8(batch.column(column))[1]).cumsum()
        while lo < n:
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(sizes, before + most, "right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi
    tidy()
