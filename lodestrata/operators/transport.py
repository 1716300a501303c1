"""Exact assignment and transport in NumPy: the kernels of the Wasserstein operators."""

from __future__ import annotations

import numpy as np


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a matching of least total cost."""
    return matched(cost)[0]


def matched(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A matching of least total cost (square; shortest augmenting paths), and prices u, v: cost >= u + v, equal where matched."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, np.int64)  # of each column, 1-based; column 0 is the root of a search
    for i in range(1, n + 1):
        row_of[0] = i
        at = 0
        low, back, used = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while row_of[at]:
            used[at] = True
            r = row_of[at]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], back[1:][better] = reduced[better], at
            free = np.flatnonzero(~used[1:]) + 1
            nxt = free[np.argmin(low[free])]
            step = low[nxt]
            u[row_of[used]] += step
            v[used] -= step
            low[1:][~used[1:]] -= step
            at = nxt
        while at:
            row_of[at], at = row_of[back[at]], back[at]
    out = np.zeros(n, np.int64)
    out[row_of[1:] - 1] = np.arange(n)
    return out, u[1:], v[1:]


def costs(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """|x - y|^order between all rows."""
    d2 = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)
    return d2 if order == 2 else np.sqrt(d2) ** order


def balanced_assignment(x: np.ndarray, y: np.ndarray, order: int = 2) -> tuple[float, np.ndarray]:
    """Wasserstein distance of two clouds of equal size, and the matching. Order 2 matches on squared costs."""
    if len(x) != len(y):
        raise ValueError("clouds of unequal size")
    c = costs(x, y, order)
    match = assignment(c)
    # the matched costs again from differences, free of the cancellation in the products
    d = np.sqrt(((x - y[match]) ** 2).sum(axis=1))
    return float((d**order).mean() ** (1 / order)), match


def second_best_gap(cost: np.ndarray, match: np.ndarray, u: np.ndarray, v: np.ndarray) -> float:
    """How much dearer the best other matching is: 0 means that match is not unique.

    Another matching differs by cycles of rows, each of which takes the column of the next. At the prices a matched edge costs
    nothing and no other less, so the cheapest such cycle, found by one pass of shortest paths between all rows, is the gap.
    """
    n = len(cost)
    if n < 2:
        return float("inf")
    near = np.maximum(cost - u[:, None] - v[None, :], 0)[:, match]
    np.fill_diagonal(near, np.inf)
    for k in range(n):
        np.minimum(near, near[:, k, None] + near[None, k, :], out=near)
    return float(near.diagonal().min())


def transport(cost: np.ndarray, source: np.ndarray, destination: np.ndarray, tolerance: float = 1e-12) -> tuple[float, np.ndarray, float]:
    """Least-cost plan between two discrete laws: (cost, plan, duality gap), by successive shortest paths.

    Each path moves the most that its source, its destination and its reverse edges allow, so marginals are exact but for rounding.
    """
    a, b = np.array(source, float), np.array(destination, float)
    if (a < 0).any() or (b < 0).any() or abs(a.sum() - b.sum()) > 1e-9 * max(1.0, a.sum()):
        raise ValueError("masses must be nonnegative and equal in total")
    n, m = cost.shape
    plan, u, v = np.zeros((n, m)), np.zeros(n), np.zeros(m)
    left, need = a.copy(), b.copy()
    v = cost.min(axis=0) - 0.0  # feasible: cost - u - v >= 0
    while left.max(initial=0) > tolerance and need.max(initial=0) > tolerance:
        dist_r = np.where(left > tolerance, 0.0, np.inf)
        dist_c, from_c, from_r = np.full(m, np.inf), np.zeros(m, np.int64), np.full(n, -1)
        done_r, done_c = np.zeros(n, bool), np.zeros(m, bool)
        reduced = cost - u[:, None] - v[None, :]
        while True:
            r = np.where(done_r, np.inf, dist_r)
            c = np.where(done_c, np.inf, dist_c)
            if min(r.min(initial=np.inf), c.min(initial=np.inf)) == np.inf:
                raise ValueError("no path")
            if r.min() <= c.min():
                i = int(r.argmin())
                done_r[i] = True
                new = dist_r[i] + np.maximum(reduced[i], 0)
                better = ~done_c & (new < dist_c)
                dist_c[better], from_c[better] = new[better], i
            else:
                j = int(c.argmin())
                done_c[j] = True
                if need[j] > tolerance:
                    break
                back = ~done_r & (plan[:, j] > tolerance) & (dist_c[j] < dist_r)
                dist_r[back], from_r[back] = dist_c[j], j
        end, stop = j, dist_c[j]
        u += np.where(done_r, stop - dist_r, 0)
        v -= np.where(done_c, stop - dist_c, 0)
        path, at = [], end
        while True:
            i = from_c[at]
            path.append((i, at, 1))
            if from_r[i] < 0:
                break
            path.append((i, from_r[i], -1))
            at = from_r[i]
        amount = min(left[path[-1][0]], need[end], *(plan[i, j] for i, j, s in path if s < 0)) if any(s < 0 for *_, s in path) else min(left[path[-1][0]], need[end])
        for i, j, s in path:
            plan[i, j] += s * amount
        left[path[-1][0]] -= amount
        need[end] -= amount
    value = float((plan * cost).sum())
    return value, plan, float(value - (u @ a + v @ b))
