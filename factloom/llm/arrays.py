"""Vectorised text primitives over Arrow buffers: numpy only, no per-word Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # bytes of text worked on at once inside a task
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RNG = np.random.default_rng(20240607)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: digits, letters and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if col.type not in (pa.string(), pa.large_string()):
        col = col.cast(pa.large_string())
    kind = np.int64 if col.type == pa.large_string() else np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes; no run crosses a row's boundary."""
    flag = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = flag.copy()
    start[1:] &= ~flag[:-1] | edge[1:-1]
    stop = flag.copy()
    stop[:-1] &= ~flag[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def prefix_sums(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Prefix sums of code[byte] * BASE**position, for hashing any stretch in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end), equal for equal bytes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data``."""
    return stretch_hashes(prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and each row's first word (n + 1 bounds)."""
    data = LOWER[data]
    starts, ends = spans(data, offsets, WORD)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of every k consecutive words, by start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : i + n]
    return mix(out)


def sliding_min_rightmost(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value (rightmost on ties) of every window of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    low = values[:n].copy()
    for i in range(1, width):
        v = values[i : i + n]
        take = v <= low
        low = np.where(take, v, low)
        best = np.where(take, np.arange(i, n + i), best)
    return best


def winnowed(values: np.ndarray, width: int) -> np.ndarray:
    """Ascending positions that are the rightmost minimum of some window of ``width``."""
    at = sliding_min_rightmost(values, width)  # never descends
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
