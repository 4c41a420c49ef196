"""Words and their fingerprints for whole Arrow columns of text, in NumPy.

A column is read as one run of UTF-8 bytes. Word borders come from a table over byte values, so both word rules of this
package work on bytes: separators are ASCII and every byte of a longer character belongs to a word. A null text has no
words. Fingerprints have 64 bits and depend on the text alone, never on the process, so a repeated task gives equal ones.
"""
from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BLANK = ~SPACES                      # word bytes of the rule [^\x20\x09-\x0D]+
ALNUM = np.zeros(256, bool)          # word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least; the tables are kept and grown."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BLOCK = 1 << 20


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Fingerprint of each range of ``values``, independent of where the range stands. ``starts`` and ``ends`` ascend."""
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):  # in blocks, so that scratch space does not follow the batch
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK)))
        low, high = int(starts[a]), int(ends[b - 1])
        part = values[low:high]
        if part.dtype != U64:
            part = part.astype(U64) + U64(1)
        up, down = powers(base, len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        first = starts[a:b] - low
        out[a:b] = mix((sums[ends[a:b] - low] - sums[first]) * down[first])
        a = b
    return out


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@functools.lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: Python workers are reused, and an idle one would keep what it once needed."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


class Words:
    """Words of a run of texts: ``start`` and ``end`` byte positions, and ``first``, the number of words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit fingerprint of each word."""
        return ranges(self.data, self.start, self.end, BYTE_BASE)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, first) of all runs of ``width`` words within one text, in order."""
    n = np.diff(first)
    k = np.maximum(n - width + 1, 0)
    at = np.arange(k.sum()) + np.repeat(first[:-1] - (np.cumsum(k) - k), k)
    return ranges(hashes, at, at + width, WORD_BASE), np.concatenate([[0], np.cumsum(k)])


def batches(stream, limit: int = 4 << 20, column: str = "text"):
    """Regroup Arrow batches so that each holds about ``limit`` bytes of ``column``, or one row that is longer."""
    held, size, given = [], 0, 0
    for batch in stream:
        data, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + limit - size, side="right")) - 1
            stop = max(stop, at if held else at + 1)
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(offsets[stop] - offsets[at])
                at = stop
            if at < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, given = [], 0, given + 1
                if given % 4 == 0:
                    release()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = None
    release()
