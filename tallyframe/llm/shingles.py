"""Sets of word shingles, hashed in blocks with NumPy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

# 64-bit multipliers (odd) of the hashes below.
_BYTE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte multiplier's powers and their inverses modulo 2**64, kept for reuse."""
    if len(_powers[0]) < size:
        size = 1 << (size - 1).bit_length()
        inverse = np.uint64(pow(int(_BYTE), -1, 1 << 64))
        for i, base in enumerate((_BYTE, inverse)):
            held = np.full(size, base, dtype=np.uint64)
            held[0] = 1
            _powers[i] = np.multiply.accumulate(held)
    return _powers[0], _powers[1]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of a block of texts, and where each text's words begin (one more entry at the end)."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", dtype=np.uint8)
    white = _WHITE[data]
    before = np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.searchsorted(starts, edges)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of fewer words than ``size`` the whole as one; of none, empty."""
    hashes, edges = words(texts)
    window = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        window = window * _WORD + hashes[k : k + len(window)]
    window = mix(window)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(window[a : b - size + 1]))
        elif b == a:
            out.append(np.empty(0, dtype=np.uint64))
        else:
            with np.errstate(over="ignore"):
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = whole * _WORD + h
            out.append(mix(np.array([whole ^ np.uint64(0xA5A5A5A5A5A5A5A5)], dtype=np.uint64)))
    return out


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return blake2b(tokens.tobytes(), digest_size=16).digest()
