"""Hashed n-grams of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def code_points(texts: list[str], gap: str = "\n\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, each followed by ``gap``; where each text with its gap ends."""
    cps = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le"), np.uint32)
    return cps, np.cumsum([len(t) + len(gap) for t in texts])


def char_grams(cps: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each code point (the last n - 1 have none)."""
    x = cps.astype(np.uint64) * _M1
    x ^= x >> np.uint64(32)
    h = x[: len(x) - n + 1].copy()
    for k in range(1, n):
        h *= BASE
        h += x[k : len(x) - n + 1 + k]
    return (mix(h + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)


def words(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and 64-bit hash of every run of other code points than ASCII white space."""
    space = (cps == 32) | ((cps >= 9) & (cps <= 13))
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    starts = np.flatnonzero(first)
    lens = np.flatnonzero(last) + 1 - starts
    if not len(starts):
        return starts, lens, np.zeros(0, np.uint64)
    inside = np.flatnonzero(~space)
    at = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = np.arange(len(inside)) - np.repeat(at, lens)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lens.max()), BASE)]), dtype=np.uint64)
    x = cps[inside].astype(np.uint64) * _M1
    x ^= x >> np.uint64(32)
    return starts, lens, mix(np.add.reduceat(x * power[place], at) + lens.astype(np.uint64))
