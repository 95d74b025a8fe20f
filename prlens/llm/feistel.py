"""Keyed Feistel permutation of 0..n-1 with cycle walking (numpy, whole arrays).

The network permutes the numbers of an even count of bits that just holds n;
values that leave the range are permuted again until they fall inside (fewer
than four rounds on average).  Inverse included, so a slot names its row.
"""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 6


def _round_keys(key: str) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{key}/{i}".encode()).digest()[:8], "little") for i in range(ROUNDS)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _half(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _once(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << bits) | right


def permute(rows: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """The slot of each row number, or with ``back`` the row of each slot."""
    half, keys = _half(n), _round_keys(key)
    out = _once(np.asarray(rows).astype(np.uint64), half, keys, back)
    while len(far := np.flatnonzero(out >= np.uint64(max(n, 1)))):
        out[far] = _once(out[far], half, keys, back)
    return out.astype(np.int64)
