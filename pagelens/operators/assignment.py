"""Minimum-cost perfect matching on a square matrix (shortest augmenting paths with potentials, O(n³))."""

from __future__ import annotations

import numpy as np


def solve(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an optimal assignment; rows are added one by one, the column scan is vectorised."""
    n = len(cost)
    row_pot = np.zeros(n)
    col_pot = np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        slack = np.full(n, np.inf)
        came = np.full(n, -1)
        done = np.zeros(n, dtype=bool)
        row, at, reached = start, -1, 0.0
        visited = [(start, 0.0)]
        while True:
            reduced = cost[row] - row_pot[row] - col_pot + reached
            better = ~done & (reduced < slack)
            slack[better] = reduced[better]
            came[better] = at
            at = int(np.where(done, np.inf, slack).argmin())
            reached = slack[at]
            done[at] = True
            if row_of[at] < 0:
                break
            row = int(row_of[at])
            visited.append((row, reached))
        for r, when in visited:
            row_pot[r] += reached - when
        col_pot[done] -= reached - slack[done]
        while at >= 0:
            before = came[at]
            row_of[at] = start if before < 0 else row_of[before]
            at = before
    columns = np.empty(n, dtype=int)
    columns[row_of] = np.arange(n)
    return columns
