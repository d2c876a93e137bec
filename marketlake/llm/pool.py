"""A bounded pool of encoded words: many texts share their words, each is encoded once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress, repeat

import numpy as np

def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs: start[0].. , start[1].., laid end to end."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


class WordPool:
    """Ids of words. ``encode`` turns a list of words into (all ids, ids of each word).

    Beyond ``most`` words the pool starts anew; with ``recurring`` it keeps the words that came up
    again since the last start, if they are at most half of ``most``.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, recurring: bool = False):
        self.encode, self.most, self.recurring = encode, most, recurring
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = 0
        self.again = np.zeros(1 << 14, bool)

    def renew(self) -> None:
        """Start anew, with the recurring words if they are kept."""
        kept = np.flatnonzero(self.again[: len(self.code)]) if self.recurring else np.empty(0, np.int64)
        if not 0 < len(kept) <= self.most // 2:
            return self.clear()
        # Words lie in the order of their codes.
        words = list(compress(self.code, self.again[: len(self.code)].tolist()))
        ids, size = self.gather(kept)
        self.clear()
        self._add(words, ids, size)

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.code)
        self.start, self.size = _room(self.start, n, len(words)), _room(self.size, n, len(words))
        self.again = _room(self.again, n, len(words))
        self.ids = _room(self.ids, self.used, len(ids))
        self.ids[self.used: self.used + len(ids)] = ids
        self.start[n: n + len(words)] = self.used + np.cumsum(size) - size
        self.size[n: n + len(words)] = size
        self.again[n: n + len(words)] = False
        self.used += len(ids)
        self.code.update(zip(words, range(n, n + len(words))))

    def codes(self, words: list[str]) -> np.ndarray:
        """The code of each word; words not seen before are encoded together."""
        if len(self.code) > self.most:
            self.renew()
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(codes < 0).tolist()
        missing = list(dict.fromkeys([words[i] for i in unknown]))
        if self.recurring:
            self.again[codes[codes >= 0]] = True
        if missing:
            self._add(missing, *self.encode(missing))
            codes[unknown] = [self.code[words[i]] for i in unknown]
        return codes

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the coded words in order, and how many each has."""
        size = self.size[codes]
        return self.ids[spread(self.start[codes], size)], size


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(a):
        return a
    out = np.empty(max(2 * len(a), used + more), a.dtype)
    out[:used] = a[:used]
    return out
