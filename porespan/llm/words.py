"""Words and their 64-bit codes, from the bytes of whole texts in arrays."""

from __future__ import annotations

import hashlib
import sys

import numpy as np

#: Runs that are hashed together; longer runs than LONG bytes are hashed one by one.
TOGETHER, LONG = 1 << 16, 128
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of eight bytes, those that belong to a run with so many left.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(text: str | bytes | None) -> np.ndarray:
    return np.frombuffer((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text) or b"", dtype=np.uint8)


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: runs of bytes other than ASCII white space."""
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs ``data[first:last]``: eight bytes at a time are mixed in, so runs of one length up to eight bytes never
    share one, and no rule makes longer ones that do; beyond LONG bytes a run's BLAKE2b digest."""
    out = np.empty(len(first), dtype=np.uint64)
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    for a in range(0, len(first), TOGETHER):
        begin, size = first[a : a + TOGETHER], (last - first)[a : a + TOGETHER]
        h = mix(size.astype(np.uint64) * _MIX + np.uint64(1)) ^ eights[begin] & _KEEP[np.minimum(size, 8)]
        h = mix(h)
        for at in range(8, min(int(size.max()), LONG), 8):
            on = np.flatnonzero(size > at)
            h[on] = mix(h[on] * _MIX + mix(eights[begin[on] + at] & _KEEP[np.minimum(size[on] - at, 8)]))
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : begin[i] + size[i]].tobytes(), digest_size=8).digest(), sys.byteorder)
        out[a : a + TOGETHER] = h
    return out


def windows(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` codes in a row, made of those of half as many."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    if n == 1:
        return mix(codes)
    half = windows(codes, n // 2)
    h = mix(half[: len(codes) - n + 1] * _MIX + half[n // 2 : n // 2 + len(codes) - n + 1])
    return mix(h * _MIX + codes[n - 1 :]) if n % 2 else h


def codes_of(data: np.ndarray) -> np.ndarray:
    """A code for each word of a text's bytes, A-Z taken as a-z."""
    return hashes(_LOWER[data], *spans(data))


def word_codes(text: str | bytes | None) -> np.ndarray:
    """A code for each word of a whole text, A-Z taken as a-z; none for null."""
    return codes_of(as_bytes(text))
