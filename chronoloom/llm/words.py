"""Words of texts as small numbers, remembered across the batches of a worker."""

from __future__ import annotations

import numpy as np


class WordBook:
    """A code per distinct word (a run of bytes other than ASCII white space)."""

    def __init__(self, room: int = 1_000_000):
        self.room = room
        self.code_of: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.era = 0

    def trim(self) -> bool:
        """Forgets all words when there are too many; codes given so far lose their meaning."""
        full = len(self.words) > self.room
        if full:
            self.code_of, self.words = {}, []
            self.era += 1
        return full

    def _met(self, word: bytes) -> int:
        code = self.code_of[word] = len(self.words)
        self.words.append(word)
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        get, met = self.code_of.get, self._met
        return np.array([met(w) if (c := get(w)) is None else c for w in words], np.int64)


class PerWord:
    """A number per word of a book, worked out once per word."""

    def __init__(self, book: WordBook, rule, kind=np.int32):
        self.book, self.rule, self.kind = book, rule, kind
        self.era, self.values = book.era, np.zeros(0, kind)

    def table(self) -> np.ndarray:
        if self.era != self.book.era:
            self.era, self.values = self.book.era, np.zeros(0, self.kind)
        new = self.book.words[len(self.values) :]
        if new:
            self.values = np.concatenate([self.values, np.array([self.rule(w) for w in new], self.kind)])
        return self.values
