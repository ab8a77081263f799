"""A worker's table of numbers per distinct word, so that each word is worked out once and a text is a sum of rows."""

from __future__ import annotations

import numpy as np


class WordTable:
    """word -> a row of `width` numbers; emptied when it outgrows `limit` words (of a bounded length each), so that memory stays bounded."""

    def __init__(self, compute, width: int, limit: int = 300_000):
        self.compute, self.width, self.limit = compute, width, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """For each list of words the sum of their rows, in double precision."""
        if len(self.at) > self.limit:
            self.clear()
        places = [list(map(self.at.get, words)) for words in texts]
        new = list({w for words, p in zip(texts, places) if None in p for w, k in zip(words, p) if k is None})
        if new:
            start = len(self.at)
            self.at.update(zip(new, range(start, start + len(new))))
            if start + len(new) > len(self.rows):
                grown = np.zeros((2 * (start + len(new)), self.width), np.float32)
                grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start : start + len(new)] = self.compute(new)
            places = [[self.at[w] for w in words] if None in p else p for words, p in zip(texts, places)]
        out = np.zeros((len(texts), self.width))
        full = [k for k, p in enumerate(places) if p]
        if full:
            flat = self.rows[np.concatenate([np.array(places[k], np.int64) for k in full])]
            starts = np.concatenate(([0], np.cumsum([len(places[k]) for k in full])[:-1]))
            out[full] = np.add.reduceat(flat.astype(np.float64), starts, axis=0)
        return out
