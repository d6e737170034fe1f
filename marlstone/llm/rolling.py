"""Polynomial hashes modulo 2**64 of all substrings of an array, from one running sum."""

from __future__ import annotations

import sys
import types

import numpy as np

#: Odd multipliers, and a table that spreads byte values over 64 bits.
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
SPREAD = np.random.Generator(np.random.PCG64(20240611)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Powers kept for the next call at most.
KEPT = 1 << 21


def shared() -> dict:
    """What the tasks of one worker process keep between them. Functions travel by value, so that
    each task has globals of its own; tables there would be garbage that piles up."""
    return sys.modules.setdefault("marlstone_shared", types.ModuleType("marlstone_shared")).__dict__


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i < n."""
    have = shared().get(base)
    if have is None or len(have[0]) < n:
        room = max(1 << 16, 1 << (n - 1).bit_length())
        up = np.full(room, base, np.uint64)
        up[0] = 1
        down = np.full(room, pow(base, -1, 2**64), np.uint64)
        down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if room <= KEPT:
            shared()[base] = have
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial's bits (in place): its low bits alone depend on few input bits."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values[i] * base ** i, from 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def windows(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hash of each ``width`` values in a row; none if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(values, base)
    return mixed((sums[width:] - sums[:n]) * powers(base, n)[1])


def slices(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The hash of each values[start:end]; the length takes part."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix(values, base)
    h = (sums[ends] - sums[starts]) * powers(base, len(values))[1][starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row, by running minima of blocks."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    room = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    room[: len(v)] = v
    room = room.reshape(blocks, width)
    ahead = np.minimum.accumulate(room, axis=1).ravel()
    back = np.minimum.accumulate(room[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
