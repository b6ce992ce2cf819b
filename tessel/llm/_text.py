"""Vectorised word splitting and hashing of an Arrow column of texts.

A word is ``[^\\x20\\x09-\\x0D]+``. A word's hash is the sum of a random 64-bit value for each byte times a power of an
odd number for its place, modulo 2**64, mixed once; equal words have equal hashes, and two of n different words meet with a
chance of about n*n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_CUT = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    out[1:] = np.uint64(_BASE)
    return np.cumprod(out, dtype=np.uint64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offset of each text (one more than texts). Null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray, marks: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (one more than texts). Marks (ASCII) part words too."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    between = _SPACE.copy()
    between[[ord(c) for c in marks]] = True
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, marks: str = "") -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    values = _BYTE[_LOWER] if lower else _BYTE.copy()
    values[[ord(c) for c in marks]] = 0
    power = _powers(int((ends - starts).max()) + 1) if len(starts) else _powers(1)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _CUT)))
        base = starts[i]
        part = data[base : ends[j - 1]]
        at = starts[i:j] - base
        place = np.arange(len(part), dtype=np.int64) - np.repeat(at, np.diff(np.append(at, len(part))))
        np.minimum(place, len(power) - 1, out=place)  # only what parts words lies beyond, and it counts 0
        out[i:j] = np.add.reduceat(values[part] * power[place], at)
        i = j
    return mix(out)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words before it."""
    data, off = raw_bytes(texts)
    starts, ends, first = word_spans(data, off)
    return word_hashes(data, starts, ends, lower), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every text (the whole sequence if a text has fewer words), and the offsets by text."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(off[-1], dtype=np.int64) + np.repeat(first[:-1] - off[:-1], count)
    full = np.repeat(n >= k, count)
    out = np.zeros(len(at), np.uint64)
    whole = at[full]
    h = np.full(len(whole), 0x243F6A8885A308D3, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(_BASE) + words[whole + j])
    out[full] = h
    for p in np.flatnonzero(~full):
        d = int(np.searchsorted(off, p, side="right") - 1)
        g = np.array([0x13198A2E03707344 + int(n[d])], np.uint64)
        for w in words[first[d] : first[d + 1]]:
            g = mix(g * np.uint64(_BASE) + w)
        out[p] = g[0]
    return out, off
