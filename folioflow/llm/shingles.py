"""Hashed word shingles and min-hashes of Arrow text columns, in numpy."""

from __future__ import annotations

import numpy as np

# Bytes of words after lower-casing: digits, a-z and every byte of longer characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (n + 1 positions)."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    hashes, starts, at = [], [], 0
    while at < n:
        end = min(n, at + PIECE)
        while end < n and WORD[data[end]] and WORD[data[end - 1]] and not first[end]:
            end += 1
        part = data[at:end]
        is_word = WORD[part]
        begins = is_word & (~np.concatenate([[False], is_word[:-1]]) | first[at:end])
        ends = is_word & (~np.concatenate([is_word[1:], [False]]) | first[at + 1 : end + 1])
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(len(part))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer than ``width`` words make one shingle, none make none."""
    hashes, at = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        rolled = rolled * BASE + hashes[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    value = value * BASE + h
            out.append(mix(np.array([value], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray, block: int = 8192) -> np.ndarray:
    """One 32-bit minimum per (factor, shift) over the upper halves of the shingles."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), block):
        np.minimum(least, (values[None, at : at + block] * factors[:, None] + shifts[:, None]).min(axis=1), out=least)
    return least
