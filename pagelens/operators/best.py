"""The best rows of each query inside one task: approximate scores choose candidates, and none that could be among the best is lost."""

from __future__ import annotations

import heapq

import numpy as np

MARGIN = 1.2e-6  # scores are rounded to six digits, so that scores nearer than 1e-6 can tie; the rest is for the order of sums


class Best:
    """Candidates for the k best of each of n queries by rounded score, then by id, over blocks of rows.

    A candidate goes when k others stand before it for sure: their scores are larger by MARGIN, or not smaller and their ids smaller."""

    def __init__(self, n: int, k: int, most: int = 4_000_000):
        self.k, self.most = k, max(most, 4 * n * k)
        self.floor = np.full(n, -np.inf)  # the k-th best score so far
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, id: np.ndarray, score: np.ndarray) -> None:
        some = score >= self.floor[query] - MARGIN
        self.parts.append((query[some], id[some], score[some]))
        self.held += int(some.sum())
        if self.held > self.most:
            self.shrink()
            self.most = max(self.most, 2 * self.held)

    def shrink(self) -> None:
        query, id, score = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((id, -score, query))
        query, id, score = query[order], id[order], score[order]
        first = np.searchsorted(query, query)  # where each row's query begins
        kth = np.flatnonzero(np.arange(len(query)) - first == self.k - 1)
        self.floor[query[kth]] = np.maximum(self.floor[query[kth]], score[kth])
        keep = score >= self.floor[query] - MARGIN
        query, id, score = query[keep], id[keep], score[keep]
        begin = np.searchsorted(query, query)
        keep = np.arange(len(query)) - begin < self.k
        for q in np.unique(query[~keep]):  # more than k within the margin: of these, only those that fewer than k with smaller ids reach
            at = np.flatnonzero(query == q) if len(query) < 1000 else np.arange(np.searchsorted(query, q), np.searchsorted(query, q, "right"))
            top: list[float] = []
            for i in at[np.argsort(id[at], kind="stable")]:
                keep[i] = len(top) < self.k or top[0] < score[i]
                if keep[i]:
                    (heapq.heappush if len(top) < self.k else heapq.heapreplace)(top, score[i])
        self.parts = [(query[keep], id[keep], score[keep])]
        self.held = int(keep.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.shrink()
        return self.parts[0]
