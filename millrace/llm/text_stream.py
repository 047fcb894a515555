"""Letters of a text as a stream of code points, for n-gram features in numpy."""

from __future__ import annotations

import numpy as np

#: Made in each worker when first needed: for every code point its lower-case code point if it is a letter, else 0.
#: A plain dict, so that what is sent to workers that cannot import this package is pickled by value, and small.
_MADE: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _MADE:
        whole = list(map(chr, range(0x110000)))
        out = np.zeros(0x110000, np.uint32)
        for k in np.flatnonzero(np.fromiter(map(str.isalpha, whole), bool, len(whole))).tolist():
            low = whole[k].lower()
            out[k] = ord(low) if len(low) == 1 else k
        _MADE["letters"] = out
    return _MADE["letters"]


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters with one 0 before, between and after words; empty if there is no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.zeros(len(points) + 2, np.uint64)
    x[1:-1] = _letters()[points]
    keep = x != 0
    if not keep.any():
        return x[:0]
    keep[:-1] |= keep[1:]  # a 0 stays where a word starts,
    keep[-1] = True  # and one ends the stream
    return x[keep]


#: Odd multipliers (from the digits of pi and e); any fixed odd numbers do.
SPREAD = np.array([0x243F6A8885A308D3, 0x13198A2E03707345, 0xB7E151628AED2A6B, 0x9E3779B97F4A7C15, 0x452821E638D01377, 0xBE5466CF34E90C6D], np.uint64)


def grams(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of every run of n code points, below 2**bits."""
    if len(x) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(x) - n + 1, np.uint64)
    for k in range(n):
        code = (code + x[k : len(x) - n + 1 + k]) * SPREAD[k]
    code ^= code >> np.uint64(29)
    return ((code * SPREAD[0]) >> np.uint64(64 - bits)).astype(np.int64)
