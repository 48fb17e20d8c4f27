"""Vectorised helpers on the UTF-8 bytes of a batch of texts (inside tasks only).

A batch is one uint8 array plus offsets. All separators used by the operators are ASCII,
so word and line borders found on bytes are those of the text. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # numpy works on slices of about this much text; a longer text is a slice of its own
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}
_factors = np.zeros(0, np.uint64)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its len + 1 offsets."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text (or one row); after the last, memory is given back."""
    _, offsets = as_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last
    release()


def release() -> None:
    """Gives memory that a task no longer needs back to the system: workers are reused, and would hold it through all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within documents: starts, ends, document of each."""
    if not len(mask):
        return (np.zeros(0, np.int64),) * 3
    borders = offsets[(offsets > 0) & (offsets < len(mask))]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[borders] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[borders - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each document as split at ``\\n`` (an empty text has one empty line)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    ends = np.concatenate([offsets[1:], breaks])
    by_start, by_end = np.lexsort((starts, doc)), np.lexsort((ends, doc))
    return starts[by_start], ends[by_end], doc[by_start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 4 * CHUNK_BYTES:  # too long to keep
            return have[:n]
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE ** place, from which the hash of any substring follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end); equal strings have equal hashes."""
    raw = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mix(raw + mix((ends - starts).astype(np.uint64)))


def _place_factors(n: int) -> np.ndarray:
    """Odd factors without a rule among them, one for each of the first n places."""
    global _factors
    if len(_factors) >= n:
        return _factors[:n]
    have = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    if len(have) <= 4 * CHUNK_BYTES:  # a longer one is not kept
        _factors = have
    return have[:n]


def piece_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), for words and lines; equal strings have equal hashes.

    Each place has a factor of its own. ``span_hash`` has powers of one base, under which strings built by
    halves (Thue-Morse words of 1,024 bytes) are alike for every base; it is for strings that overlap and
    are compared later on.
    """
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
    value = data[np.repeat(starts, sizes) + place].astype(np.uint64) + np.uint64(1)
    value *= _place_factors(int(sizes.max(initial=0)))[place]
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + mix(sizes.astype(np.uint64)))


def count_in(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of 0/1 values in each document."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
