"""Rows of numbers for words, computed in bulk and remembered by a worker within bounds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def code_points(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and the length of each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return points, np.fromiter(map(len, words), np.int64, len(words))


class WordTable:
    """One row of ``width`` numbers for each word; ``compute`` gives the rows of new words.

    Held in a broadcast value it lives as long as the worker process, so that tasks
    that run one after the other share it.  It is emptied when ``limit`` is reached.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, limit: int):
        self.compute, self.width, self.limit = compute, width, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row numbers in ``table``, valid until the next call."""
        at, seen = self.at, set(words)
        new = [w for w in seen if w not in at]
        if len(at) + len(new) > self.limit and at:
            self._clear()
            at, new = self.at, list(seen)
        first = len(at)
        if first + len(new) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), first + len(new)), self.width), np.float32)
            grown[:first] = self.table[:first]
            self.table = grown
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.table[first + i : first + i + len(part)] = self.compute(part)
        at.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))
