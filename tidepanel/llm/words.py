"""Words of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, which equals
``[^\\x20\\x09-\\x0D]+`` over code points. Words and windows of words get 64-bit
Rabin-Karp hashes: table values of the bytes (or the hashes of the words) times
powers of an odd base modulo 2**64, taken from running sums, then mixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Longest stretch hashed in one go; longer words are hashed one by one.
SEGMENT = 1 << 20
_BASE, _ROLL = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1

#: An odd number for mixing pairs of hashes.
END_MARK = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below SEGMENT."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(SEGMENT, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return bytes_[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``most`` bytes together, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[cuts] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice of bytes; slices are in order and apart."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(_BASE)
    values = _byte_values()
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + SEGMENT, side="right"))
        if j <= i:
            digest = hashlib.blake2b(data[base : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
            continue
        part = values[data[base : ends[j - 1]]]
        part *= up[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every ``n`` consecutive values."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(_ROLL)
    out = np.empty(m, np.uint64)
    step = SEGMENT - n
    for lo in range(0, m, step):
        hi = min(lo + step, m)
        part = hashes[lo : hi + n - 1] * up[: hi - lo + n - 1]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        out[lo:hi] = (sums[n:] - sums[:-n]) * down[: hi - lo]
    return mix(out)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` words stay in one row; ``first`` as from bounds()."""
    total = int(first[-1])
    ok = np.zeros(max(total - n + 1, 0), bool)
    if not len(ok):
        return ok
    change = np.zeros(total + 1, np.int32)
    lo, hi = first[:-1], first[1:] - n + 1
    fits = hi > lo
    np.add.at(change, lo[fits], 1)
    np.add.at(change, hi[fits], -1)
    return np.cumsum(change[: len(ok)]) > 0


def runs(lo: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... counts[0] of them, then the same from lo[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(lo - (ends - counts), counts)


def narrow(values: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest type; widen() tells it from the length."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64
    return values.astype(kind).tobytes()


def widen(blob: bytes, n: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(blob) // n] if n else np.uint8
    return np.frombuffer(blob, kind).astype(np.int64)
