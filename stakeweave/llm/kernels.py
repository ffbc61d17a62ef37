"""Vectorised text kernels shared by the Arrow operators of this subpackage.

All kernels read the UTF-8 bytes of an Arrow string column in place.  A null text
reads as the empty text.  Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]``; these six bytes never occur inside a multi-byte character, so
byte runs and character runs are the same.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE_BYTES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that a kernel works on at once, so that its arrays stay in a core's cache; one longer text is its own chunk.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15


def release() -> None:
    """Give freed memory back: workers outlive their tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(function):
    """A batch function that gives freed memory back when its task ends."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Random numbers for each byte at each place in a span of up to ``PLACES`` bytes.
PLACES = 64
_DRAWN = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(_BASE))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans ``data[start:end]``, which rise and don't overlap.

    A span's bytes add up the numbers drawn for them at their places (tabulation hashing), so two
    spans that differ have equal sums with probability 2**-64 over the draw, whatever their pattern.  Longer spans are
    hashed by XXH64, one by one.
    """
    size = end - start
    place = np.zeros(len(data), np.int32)
    place[start] = start
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data), dtype=np.int32), place, out=place)
    np.minimum(place, PLACES - 1, out=place)
    place <<= 8
    place |= data
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_DRAWN[place], out=total[1:])
    h = mix(total[end] - total[start] + size.astype(np.uint64) * np.uint64(_BASE))
    for i in np.flatnonzero(size > PLACES).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), int(size[i]))
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``len + 1`` offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row that is longer."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, min(last, n)
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every word of the texts that ``offsets`` cuts ``data`` into.

    ``table`` tells which bytes belong to words.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = table[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after[cut - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def shingle_hash(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and their rows; a shorter row gives its whole run."""
    count = np.bincount(rows, minlength=n_rows)
    if len(words) >= size:
        h = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            h = mix(h * np.uint64(_BASE) + words[k : len(words) - size + 1 + k])
        whole = rows[: len(h)] == rows[size - 1 :]
        h, row = h[whole], rows[: len(whole)][whole]
    else:
        h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            live = count[short] > k
            at = np.where(live, first[short] + k, 0)
            extra = np.where(live, words[at] if k == 0 else mix(extra * np.uint64(_BASE) + words[at]), extra)
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row
