"""Vectorised 64-bit hashes of words and word windows over Arrow text, for use inside tasks.

Words are maximal runs of bytes other than the six ASCII white-space bytes, so UTF-8 text is cut without
decoding it. A word's hash is a polynomial over random byte values modulo 2**64, finished by a mixer; all
words of a segment are hashed at once from one running sum. Segments are bounded, whatever a text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _SEGMENT + 4096)
        ups, downs = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
        ups[0] = downs[0] = 1
        _POWERS[:] = [np.multiply.accumulate(ups), np.multiply.accumulate(downs)]
    return _POWERS[0], _POWERS[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its len + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def _segments(raw: np.ndarray, offsets: np.ndarray):
    """Bounded stretches that cut no word: a stretch ends at white space or where a text ends."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + _SEGMENT)
        while hi < n:
            ends = offsets[np.searchsorted(offsets, lo, "right"): np.searchsorted(offsets, hi, "right")]
            gaps = np.flatnonzero(SPACE[raw[lo:hi]])
            best = max(int(ends[-1]) if len(ends) else 0, lo + int(gaps[-1]) + 1 if len(gaps) else 0)
            if best > lo:
                hi = best
                break
            hi = min(n, hi + _SEGMENT)  # one word longer than a segment
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions) and hash of every word, and len(offsets) positions in them: words of
    text i are [first[i], first[i + 1])."""
    starts, ends, hashes = [], [], []
    for lo, hi in _segments(raw, offsets):
        part = raw[lo:hi]
        gap = np.ones(len(part) + 1, dtype=bool)
        gap[:-1] = SPACE[part]
        new = np.zeros(len(part) + 1, dtype=bool)  # where a text begins
        at = offsets[np.searchsorted(offsets, lo): np.searchsorted(offsets, hi, "right")] - lo
        new[at] = True
        before = np.empty(len(part) + 1, dtype=bool)
        before[0], before[1:] = True, gap[:-1]
        s = np.flatnonzero(~gap & (before | new))
        e = np.flatnonzero(~before & (gap | new))
        up, down = _powers(len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(h + (e - s).astype(np.uint64)))
    s, e, h = (np.concatenate(x) if x else np.empty(0, t)
               for x, t in ((starts, np.int64), (ends, np.int64), (hashes, np.uint64)))
    return s, e, h, np.searchsorted(s, offsets)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of `size` consecutive entries; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    factor, out = 1, np.full(n, (seed * 0x2545F4914F6CDD1D + size) % (1 << 64), dtype=np.uint64)
    for j in range(size):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        out += hashes[j: j + n] * np.uint64(factor)
    return mix(out)
