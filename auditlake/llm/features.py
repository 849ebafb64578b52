"""Hashed words of a text, for the classifiers."""

from __future__ import annotations

import re
import zlib

import numpy as np

TOKEN = re.compile(r"[^\W_]+")
REMEMBERED = 400_000


class Hasher:
    """Words to buckets; a bounded memory of words seen before."""

    def __init__(self, bits: int, prefixes: tuple[int, ...] = ()):
        self.mask, self.prefixes = (1 << bits) - 1, prefixes
        self.known: dict[str, tuple[int, ...]] = {}

    def buckets(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            names = [word, *(f"{word[:n]}*" for n in self.prefixes if len(word) > n)]
            found = tuple(zlib.crc32(name.encode()) & self.mask for name in names)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def present(self, text: str) -> np.ndarray:
        """Buckets of the distinct lower-case words (and their prefixes) of a whole text."""
        words = set(TOKEN.findall(text.lower()))
        found = {b for w in words for b in self.buckets(w)}
        return np.fromiter(found, np.int64, len(found))


def stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated indices, and the row of each."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), sizes)
