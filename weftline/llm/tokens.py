"""Vectorised words: a batch of texts becomes NumPy arrays of word bounds and 64-bit hashes.

The hash of a word depends on its code points alone, so it is the same in any
batch, task or run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_powers = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 18)
        _powers = tuple(np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, p, _U))]) for p in (_P, _P_INV))
    return _powers


class Words:
    """Words of several texts, in order.

    cp: code points of all texts, each followed by a line feed; text_end: where
    each text's line feed is; start, end: bounds of words in cp; doc: index of
    each word's text; first: offset of each text's first word, and the total.
    """

    def __init__(self, texts: Sequence[str], lower: bool = False, drop: np.ndarray | None = None):
        """lower: fold A-Z; drop: table over code points below 128 that are removed first."""
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        if lower:
            cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
        if drop is not None:
            keep = ~drop[np.minimum(cp, 127)]
            text_end = np.cumsum(keep)[text_end] - 1
            cp = cp[keep]
        letter = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
        edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
        self.cp, self.text_end = cp, text_end
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(text_end, self.start, "right").astype(np.int32)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def __len__(self) -> int:
        return len(self.start)

    def chars(self) -> np.ndarray:
        """A hash of each code point."""
        x = (self.cp.astype(_U) + _U(0x632BE59BD9B4E019)) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))

    def hashes(self, chars: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of code point hashes times powers."""
        if not len(self.start):
            return np.zeros(0, _U)
        power, inverse = _power_tables(len(self.cp) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((self.chars() if chars is None else chars) * power[: len(self.cp)])])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words inside one text, and where each run begins."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    total = np.zeros(n, _U)
    for k in range(size):
        total = total * _P + h[k : k + n]
    return mix(total[at]), at
