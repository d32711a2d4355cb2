"""Words of many texts at once, on arrays of code points."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Code points from here on are unassigned or marks and selectors, which are no letters or digits.
TABLE_END = 0x323B0
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case (where that is one code point), is it a letter, is it a letter or digit."""
    chars = [chr(i) for i in range(TABLE_END)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    end = np.zeros(0x110000 - TABLE_END, bool)
    alpha = np.r_[np.array([c.isalpha() for c in chars]), end]
    alnum = np.r_[np.array([c.isalnum() for c in chars]), end]
    return np.r_[lower, np.arange(TABLE_END, 0x110000, dtype=np.uint32)], alpha, alnum


class Words:
    """Words of one string: runs of letters (or letters and digits), lower-cased.

    chars: their code points without the gaps; first: where each word begins in chars; size: its length;
    start: where it begins in the string.
    """

    def __init__(self, text: str, digits: bool = False):
        lower, alpha, alnum = tables()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero((alnum if digits else alpha)[points])
        self.chars = lower[points[at]]
        begins = np.ones(len(at), bool)
        begins[1:] = at[1:] != at[:-1] + 1
        self.first = np.flatnonzero(begins)
        self.size = np.diff(np.r_[self.first, len(at)])
        self.start = at[self.first]

    def place(self) -> np.ndarray:
        """Each char's place in its word."""
        return np.arange(len(self.chars)) - np.repeat(self.first, self.size)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        powers = np.multiply.accumulate(np.full(int(self.size.max()), BASE, np.uint64))
        return mix(np.add.reduceat(powers[self.place()] * (self.chars.astype(np.uint64) + np.uint64(1)), self.first))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def chunks(texts: list[str | None], most: int = 1 << 19):
    """Runs of texts of about so many characters together: (first index, texts); a longer text comes alone."""
    at, n = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if n and n + size > most:
            yield at, [t or "" for t in texts[at:i]]
            at, n = i, 0
        n += size
    if at < len(texts):
        yield at, [t or "" for t in texts[at:]]
