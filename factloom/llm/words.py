"""64-bit hashes of words, each computed once while it is remembered."""

from __future__ import annotations

import numpy as np
import xxhash


class Words(dict):
    """Word to hash; forgets all when it holds ``kept`` words, which changes no result."""

    def __init__(self, kept: int = 1_000_000):
        super().__init__()
        self._kept = kept

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def hashes(self, words: list[str]) -> np.ndarray:
        if len(self) > self._kept:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), "<u8", len(words))
