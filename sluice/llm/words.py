"""Words of a text as arrays: code points, spans and hashes, worked out for a whole text at a time.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np

MIX = 6364136223846793005
_powers: dict[int, np.ndarray] = {}


def codepoints(text: str, *, lower: bool = False) -> np.ndarray:
    """Code points as unsigned 32-bit numbers; with lower, A-Z become a-z."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint32) if lower else cp


def spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words."""
    inside = np.ones(len(cp) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(64, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
        if size > 1 << 20:
            del _powers[base]
    return have[:n]


def hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = MIX) -> np.ndarray:
    """Polynomial hash of each span modulo 2**64: from 0, h = h * base + code point, character by character."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    back = np.arange(total) - np.repeat(first, lengths)  # place in the word
    at = back + np.repeat(starts, lengths)
    exponent = np.repeat(lengths, lengths) - 1 - back
    return np.add.reduceat(cp[at] * powers(base, int(lengths.max()))[exponent], first)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A mixed hash of each n words in a row."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out ^ h[i : i + len(out)]) + np.uint64(i + 1)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
