"""XXH64 of many byte ranges at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_ranges(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:start+length] for each range, as uint64.

    Ranges of under 32 bytes have no stripes, so the whole hash is a few masked array steps; longer ones, rare among
    short shingles, go to the C library one by one.
    """
    out = np.empty(len(starts), np.uint64)
    short = lengths < 32
    s, n = (starts, lengths) if short.all() else (starts[short], lengths[short])
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    words4 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + P5 + n.astype(np.uint64)
        at = s.astype(np.int64)
        eights = n >> 3
        for lane in range(3):
            on = np.flatnonzero(eights > lane)
            if len(on):
                k = _rotl(words8[at[on]] * P2, 31) * P1
                h[on] = _rotl(h[on] ^ k, 27) * P1 + P4
                at[on] += 8
        on = np.flatnonzero(n & 4)
        if len(on):
            h[on] = _rotl(h[on] ^ (words4[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
            at[on] += 4
        ones = n & 3
        for lane in range(3):
            on = np.flatnonzero(ones > lane)
            if len(on):
                h[on] = _rotl(h[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
                at[on] += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        h ^= h >> np.uint64(32)
    if short.all():
        return h
    out[short] = h
    view = memoryview(data)
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(view[starts[i] : starts[i] + lengths[i]], seed)
    return out
