"""Quantile summary of Greenwald and Khanna with a nearest-rank query."""

from __future__ import annotations

import math
from bisect import bisect_right


class QuantileSummary:
    """Entries (value, gap to the entry before in rank, uncertainty of rank), ascending."""

    def __init__(self, epsilon: float):
        self.epsilon, self.n = epsilon, 0
        self.values: list[float] = []
        self.gaps: list[int] = []
        self.slack: list[int] = []

    def add(self, value: float) -> None:
        at = bisect_right(self.values, value)
        inner = 0 < at < len(self.values)
        self.values.insert(at, value)
        self.gaps.insert(at, 1)
        self.slack.insert(at, math.floor(2 * self.epsilon * self.n) if inner else 0)
        self.n += 1
        if self.n % max(1, math.floor(1 / (2 * self.epsilon))) == 0:
            self._compress()

    def _compress(self) -> None:
        limit = math.floor(2 * self.epsilon * self.n)
        for i in range(len(self.values) - 2, 0, -1):
            after = i + 1
            if self.slack[i] >= self.slack[after] and self.gaps[i] + self.gaps[after] + self.slack[after] < limit:
                self.gaps[after] += self.gaps[i]
                del self.values[i], self.gaps[i], self.slack[i]

    def quantile(self, p: float) -> float:
        """The value whose middle rank is nearest to p * (n - 1) + 1, the first of equals."""
        if not self.values:
            raise ValueError("no values")
        rank, margin = p * (self.n - 1) + 1, math.ceil(self.epsilon * self.n)
        best, least, low = None, math.inf, 0
        for value, gap, slack in zip(self.values, self.gaps, self.slack, strict=True):
            low += gap
            high = low + slack
            off = abs(rank - (low + high) / 2)
            if rank - margin <= low and high <= rank + margin and off < least:
                best, least = value, off
        return self.values[-1] if best is None else best
