"""Whole texts as NumPy arrays: words, 64-bit hashes, shingle sets. Used inside tasks only."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for ``i < n``, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``substring_hash`` takes the hash of any substring."""
    up, _ = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE_CODE[b] * up[: len(b)], out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``[start, end)``; equal substrings have equal hashes wherever they lie."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``[^\\x20\\x09-\\x0D]``."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[b]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of the text, A-Z taken as a-z."""
    b = LOWER[utf8(text)]
    starts, ends = word_bounds(b)
    if not len(starts):
        return np.empty(0, np.uint64)
    return substring_hash(prefix_hash(b), starts, ends)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words.

    A text of fewer words has its whole sequence as its one shingle; no word, no shingle.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = mix(total * _GOLDEN + words[i : i + len(total)])
    return np.unique(total)
