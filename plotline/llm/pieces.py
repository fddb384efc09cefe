"""Vectorised lookup of vocabulary pieces in words."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


class PieceTable:
    """For each piece length: sorted 64-bit rolling hashes, and the piece numbers in that order."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        by: dict[int, list[tuple[str, int]]] = {}
        for i, p in enumerate(pieces):
            if p:
                by.setdefault(len(p), []).append((p, i))
        self.tables = {}
        for n, items in by.items():
            columns = codes([p for p, _ in items])
            h = np.zeros(len(items), np.uint64)
            for k in range(n):
                h = h * _BASE + columns[:, k] + np.uint64(1)
            order = np.argsort(h)
            self.tables[n] = h[order], np.array([i for _, i in items])[order]

    def edges(self, words: list[str]) -> list[tuple[int, np.ndarray]]:
        """Edges of the lattices of words of one length: for each piece length the piece number at each start, or -1.

        A character that is no piece gets the number ``size``, so every word has a segmentation.
        """
        at_codes = codes(words)
        n, length = at_codes.shape
        out = []
        h = np.zeros((n, length), np.uint64)
        for k in range(1, min(length, max(self.tables, default=1)) + 1):
            h = h[:, : length - k + 1] * _BASE + at_codes[:, k - 1 :] + np.uint64(1)
            if k in self.tables:
                keys, ids = self.tables[k]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found = np.where(keys[at] == h, ids[at], -1)
            else:
                found = np.full(h.shape, -1)
            if k == 1:
                found = np.where(found < 0, self.size, found)
            if k == 1 or (found >= 0).any():
                out.append((k, found))
        return out
