"""Quadratic programs over the simplex in NumPy, and the projections onto it."""

from __future__ import annotations

import numpy as np


def project_simplex(w: np.ndarray) -> np.ndarray:
    """The nearest point of the simplex, by the threshold of the sorted coordinates."""
    s = np.sort(w)[::-1]
    excess = np.cumsum(s) - 1
    k = np.flatnonzero(s - excess / np.arange(1, len(w) + 1) > 0)[-1]
    return np.maximum(w - excess[k] / (k + 1), 0)


def project_capped(w: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point of the simplex with no coordinate above cap, by bisection on the shift."""
    if cap * len(w) < 1 - 1e-12:
        raise ValueError("the cap leaves no feasible weights")
    low, high = w.min() - 1.0, w.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(w - mid, 0, cap).sum() > 1 else (low, mid)
    return np.clip(w - (low + high) / 2, 0, cap)


def simplex_qp(q: np.ndarray, c: np.ndarray, cap: float = 1.0, tolerance: float = 1e-12, rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """Minimise 0.5 w'Qw + c'w over the (capped) simplex for positive semidefinite Q on it. Returns w and the linear-oracle gap."""
    n = len(c)
    project = project_simplex if cap >= 1 else (lambda w: project_capped(w, cap))
    step = 1 / max(np.abs(np.linalg.eigvalsh(q)).max(), 1e-12)
    w = y = project(np.full(n, 1 / n))
    t, gap = 1.0, np.inf
    for k in range(rounds):
        new = project(y - step * (q @ y + c))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / nt * (new - w)
        if (q @ new + c) @ (new - w) > 0:  # overshoot: restart the momentum
            y, nt = new, 1.0
        w, t = new, nt
        if k % 10 == 0:
            g = q @ w + c
            gap = float(g @ w - g @ lowest_vertex(g, cap))
            if gap <= tolerance * max(1.0, np.abs(g).max()):
                break
    return w, gap


def lowest_vertex(g: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """The feasible point of least g'w."""
    out, left = np.zeros(len(g)), 1.0
    for i in np.argsort(g, kind="stable"):
        out[i] = min(cap, left)
        left -= out[i]
        if left <= 0:
            break
    return out


def affine_qp(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Minimise 0.5 w'Qw + c'w with weights that sum to one, of any sign."""
    n = len(c)
    kkt = np.block([[q, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    return np.linalg.lstsq(kkt, np.append(-c, 1.0), rcond=None)[0][:n]


def free_qp(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Minimise 0.5 w'Qw + c'w without constraints."""
    return np.linalg.lstsq(q, -c, rcond=None)[0]


def mean_norm_simplex(x: np.ndarray, z: np.ndarray, tolerance: float = 1e-9, rounds: int = 2000) -> tuple[np.ndarray, float, float]:
    """Weights on the simplex that minimise the mean length of x - sum w_k z_k over points, its value, and a certified gap.

    x: points x width, z: candidates x points x width. Each round solves the quadratic bound that touches the objective at the
    present weights; the gap is that of the linear oracle on a subgradient there, which bounds how far the value is from the least.
    """
    n, k = len(x), len(z)
    w = np.full(k, 1 / k)
    scale = max(float(np.linalg.norm(z, axis=2).max(initial=0)), float(np.linalg.norm(x, axis=1).max(initial=0)), 1e-300)
    best = (np.inf, w, np.inf)
    for _ in range(rounds):
        left = x - np.tensordot(w, z, 1)
        length = np.linalg.norm(left, axis=1)
        unit = np.divide(left, length[:, None], out=np.zeros_like(left), where=length[:, None] > 0)
        g = -np.einsum("kmd,md->k", z, unit) / n
        value, gap = float(length.mean()), max(float(w @ g - g.min()), 0.0)
        if value < best[0] or gap < best[2]:
            best = (value, w, gap)
        if gap <= tolerance * (1 + value):
            break
        weight = 1 / np.maximum(length, 1e-12 * scale)
        q = np.einsum("kmd,lmd,m->kl", z, z, weight, optimize=True) / n
        c = -np.einsum("kmd,md,m->k", z, x, weight, optimize=True) / n
        new, _ = simplex_qp(q, c, rounds=4000)
        if np.abs(new - w).max() <= 1e-15:
            break
        w = new
    return best[1], best[0], best[2]


def tangent_curvature(q: np.ndarray) -> float:
    """The least eigenvalue of Q among directions that keep the sum of the weights."""
    n = len(q)
    if n < 2:
        return 0.0
    basis = np.linalg.qr(np.eye(n)[:, :-1] - np.eye(n)[:, -1:])[0]
    return float(np.linalg.eigvalsh(basis.T @ (q + q.T) @ basis / 2).min())
