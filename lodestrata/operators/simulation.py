"""Numerical kernels of the game simulator, and their spread over Spark tasks: sequential within a path, parallel over paths."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.contracts import none, require


def natural_residual(x: np.ndarray, field: np.ndarray) -> float:
    """Largest violation of x >= 0, F >= 0, x F = 0."""
    return float(np.abs(x - np.maximum(x - field, 0)).max())


def solve_orthant(field: Callable[[np.ndarray], np.ndarray], start: np.ndarray, modulus: float, target: float = 1e-10, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """Solve the variational inequality of a strongly monotone field on the nonnegative orthant by extragradient steps with a line search.

    Returns the point and a bound of its distance from the solution, (1 + L / modulus) times the natural residual.
    """
    x, step, lip = np.maximum(start, 0.0), 1.0, 0.0
    for _ in range(rounds):
        f = field(x)
        r = natural_residual(x, f)
        bound = (1 + lip) / modulus * r
        if bound <= target:
            return x, bound
        while True:
            y = np.maximum(x - step * f, 0)
            g = field(y)
            move = np.linalg.norm(y - x)
            change = np.linalg.norm(g - f)
            if move:
                lip = max(lip, change / move)
            if step * change <= 0.7 * move or move == 0:
                break
            step *= 0.5
        x = np.maximum(x - step * g, 0)
        step *= 1.2
    raise RuntimeError(f"residual {r} after {rounds} rounds")


def van_der_corput(n: int, base: int) -> np.ndarray:
    """The first n points of a low-discrepancy sequence on (0, 1)."""
    out = np.zeros(n)
    k, scale = np.arange(1, n + 1), 1.0 / base
    while k.any():
        out += scale * (k % base)
        k //= base
        scale /= base
    return out


def economy(firms: int, activities: int, seed: int = 0, curvature: float = 1.0, interaction: float = 0.3) -> dict[str, np.ndarray]:
    """Sites on a low-discrepancy grid, opportunity levels and a strongly monotone interaction over firm x activity intensities."""
    return economy_of(1 + np.random.default_rng(seed).random((firms, activities)), curvature, interaction)


def economy_of(level: np.ndarray, curvature: float = 1.0, interaction: float = 0.3) -> dict[str, np.ndarray]:
    """An economy with given opportunity levels, firm x activity."""
    activities = level.shape[1]
    sites = np.stack([van_der_corput(activities, 2), van_der_corput(activities, 3)], axis=1)
    d = np.sqrt(((sites[:, None] - sites[None]) ** 2).sum(axis=2))
    kernel = np.exp(-d)
    return {"sites": sites, "kernel": kernel / np.linalg.eigvalsh(kernel).max(), "level": level, "curvature": np.array(curvature), "interaction": np.array(interaction)}


def advance(e: dict[str, np.ndarray], q: np.ndarray, level: np.ndarray, anchor: float = 0.5) -> tuple[np.ndarray, float]:
    """One simultaneous move: each firm's marginal cost of intensity, pull to its last one and rivals' presence nearby against opportunity."""
    c, g, k = float(e["curvature"]), float(e["interaction"]), e["kernel"]

    def field(x: np.ndarray) -> np.ndarray:
        z = x.reshape(q.shape)
        return (c * z + anchor * (z - q) + g * (z.sum(axis=0, keepdims=True) @ k) - level).ravel()

    x, bound = solve_orthant(field, q.ravel(), c + anchor)
    return x.reshape(q.shape), bound


def path(e: dict[str, np.ndarray], innovations: np.ndarray, persistence: float = 0.8, spread: float = 0.1) -> np.ndarray:
    """Intensities (period, firm, activity) along opportunity levels with autoregressive innovations."""
    q, shock, out = np.zeros_like(e["level"]), np.zeros_like(e["level"]), []
    for z in innovations:
        shock = persistence * shock + spread * z
        q, _ = advance(e, q, np.maximum(e["level"] + shock, 0.0))
        out.append(q)
    return np.stack(out)


def linear_response(e: dict[str, np.ndarray], q: np.ndarray, direction: np.ndarray, anchor: float = 0.5) -> np.ndarray:
    """Change of the active intensities per unit of a direction of opportunity, by a linear solve on the active set."""
    c, g, k = float(e["curvature"]), float(e["interaction"]), e["kernel"]
    n, m = q.shape
    a = np.kron(np.eye(n), (c + anchor) * np.eye(m)) + g * np.kron(np.ones((n, n)), k.T)
    on = q.ravel() > 0
    out = np.zeros(n * m)
    if on.any():
        out[on] = np.linalg.solve(a[np.ix_(on, on)], direction.ravel()[on])
    return out.reshape(q.shape)


def gmres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, tolerance: float = 1e-12, rounds: int | None = None) -> tuple[np.ndarray, float]:
    """Solve A x = b from products with A alone: (x, relative residual). Exact after as many steps as b is long."""
    size = np.linalg.norm(b)
    if not size:
        return np.zeros_like(b), 0.0
    basis, h = [b / size], np.zeros((len(b) + 1, len(b)))
    for k in range(min(rounds or len(b), len(b))):
        w = apply(basis[k])
        for i, q in enumerate(basis):
            h[i, k] = q @ w
            w = w - h[i, k] * q
        h[k + 1, k] = np.linalg.norm(w)
        rhs = np.zeros(k + 2)
        rhs[0] = size
        y = np.linalg.lstsq(h[: k + 2, : k + 1], rhs, rcond=None)[0]
        left = np.linalg.norm(rhs - h[: k + 2, : k + 1] @ y) / size
        if left <= tolerance or h[k + 1, k] <= 1e-14 * size:
            break
        basis.append(w / h[k + 1, k])
    return np.stack(basis[: len(y)], axis=1) @ y, float(left)


def local_model(e: dict[str, np.ndarray], q: np.ndarray, directions: np.ndarray, anchor: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Values at an equilibrium and their response to directions of opportunity: (values by firm, responses, worst residual).

    A firm's value is its opportunity less its costs at the intensities q. Intensities respond on the active set, by GMRES with
    the operator restricted to it; inactive ones stay at zero. responses: (direction, firm), the derivative of the values.
    """
    c, g, k = float(e["curvature"]), float(e["interaction"]), e["kernel"]
    on = (q > 0).ravel()

    def restricted(x: np.ndarray) -> np.ndarray:
        full = np.zeros(q.size)
        full[on] = x
        z = full.reshape(q.shape)
        return ((c + anchor) * z + g * (z.sum(axis=0, keepdims=True) @ k)).ravel()[on]

    presence = q.sum(axis=0, keepdims=True) @ k
    values = (e["level"] * q - c * q * q / 2 - g * q * presence).sum(axis=1)
    slope = e["level"] - c * q - g * presence
    out, worst = np.zeros((len(directions), len(q))), 0.0
    for r, d in enumerate(directions):
        move = np.zeros(q.size)
        if on.any():
            move[on], left = gmres(restricted, d.ravel()[on])
            worst = max(worst, left)
        dq = move.reshape(q.shape)
        out[r] = (d * q + slope * dq - g * q * (dq.sum(axis=0, keepdims=True) @ k)).sum(axis=1)
    return values, out, worst


class Firm:
    """One firm of the lifecycle: it reads what all have committed, stages its own move, and commits it when told to."""

    def __init__(self, number: int, intensity: np.ndarray):
        self.number, self.intensity, self.staged = number, intensity, None

    def stage(self, proposal: np.ndarray) -> None:
        self.staged = proposal[self.number]

    def commit(self) -> None:
        self.intensity, self.staged = self.staged, None


def lifecycle(e: dict[str, np.ndarray], innovations: np.ndarray, persistence: float = 0.8, spread: float = 0.1) -> np.ndarray:
    """The path of the economy by firms that all stage before any commits, so no firm sees another's move of the same period."""
    firms = [Firm(k, np.zeros(e["level"].shape[1])) for k in range(len(e["level"]))]
    shock, out = np.zeros_like(e["level"]), []
    for z in innovations:
        shock = persistence * shock + spread * z
        committed = np.stack([f.intensity for f in firms])
        proposal, _ = advance(e, committed, np.maximum(e["level"] + shock, 0.0))
        for f in firms:
            f.stage(proposal)
        for f in firms:
            f.commit()
        out.append(np.stack([f.intensity for f in firms]))
    return np.stack(out)


def reported_law(activities: DataFrame) -> DataFrame:
    """(firm, atom, sign, mass): intensity times share, normalised by firm (null where not positive), half on each antipodal point."""
    w = activities.withColumn("w", F.col("intensity") * F.col("share"))
    total = w.groupBy("firm").agg(F.sum("w").alias("t"))
    met = w.join(total, "firm").withColumn("p", F.when(F.col("t") > 0, F.col("w") / F.col("t")))
    return met.select("firm", F.col("activity").alias("atom"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"), (F.col("p") / 2).alias("mass"))


def histories(markets: DataFrame, dates: int = 4, floor: float = -1e9) -> DataFrame:
    """(market, history, date, news, level): all sign patterns of dated news of each market's size (market, size), and their running
    sums; leaving the domain is an error.
    """
    signed = markets.select("market", "size", F.explode(F.sequence(F.lit(0), F.lit((1 << dates) - 1))).alias("history"))
    news = F.expr(f"transform(sequence(0, {dates - 1}), d -> if(shiftright(history, {dates - 1} - d) % 2 = 1, 1.0D, -1.0D) * size)")
    dated = signed.select("market", "history", news.alias("all"), F.posexplode(news).alias("date", "news"))
    out = dated.select("market", "history", "date", "news", F.aggregate(F.slice("all", 1, F.col("date") + 1), F.lit(0.0), lambda a, x: a + x).alias("level"))
    return require(out, inside=none(F.col("level") < floor))


def _grid(pdf: pd.DataFrame) -> tuple[list, list, np.ndarray]:
    """Firms, activities and levels of one economy; a cell without a row has no opportunity."""
    wide = pdf.pivot(index="firm", columns="activity", values="level").fillna(0.0).sort_index().sort_index(axis=1)
    return list(wide.index), list(wide.columns), wide.to_numpy(float)


def _kinds(levels: DataFrame) -> dict[str, str]:
    return {c: levels.schema[c].dataType.simpleString() for c in ("economy", "firm", "activity")}


def simulate(levels: DataFrame, periods: int, spread: float = 0.1, seed: int = 0, interaction: float = 0.3) -> DataFrame:
    """(economy, period, firm, activity, intensity): the path of each economy (economy, firm, activity, level) in a task of its own.

    Innovations are seeded by the economy's name, so a lost task gives the same path again.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        firms, activities, level = _grid(pdf)
        name = pdf["economy"].iloc[0]
        z = np.random.default_rng([seed, zlib.crc32(str(name).encode())]).normal(size=(periods, *level.shape))
        q = path(economy_of(level, interaction=interaction), z, spread=spread)
        t, f, a = (x.ravel() for x in np.indices(q.shape))
        return pd.DataFrame({"economy": name, "period": t, "firm": [firms[i] for i in f], "activity": [activities[i] for i in a], "intensity": q.ravel()})

    kind = _kinds(levels)
    return levels.groupBy("economy").applyInPandas(run, f"economy {kind['economy']}, period int, firm {kind['firm']}, activity {kind['activity']}, intensity double")


def responses(levels: DataFrame, periods: int, interaction: float = 0.3) -> DataFrame:
    """(economy, firm, intensity, response, staged, residual) after some periods without news, each economy in a task of its own.

    response: the derivative of a firm's value as all opportunity rises alike; staged: firms that stage their moves and commit
    together come to the same intensities.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        firms, _, level = _grid(pdf)
        e, still = economy_of(level, interaction=interaction), np.zeros((periods, *level.shape))
        q = path(e, still)
        _, slopes, left = local_model(e, q[-1], np.ones((1, *level.shape)))
        return pd.DataFrame({"economy": pdf["economy"].iloc[0], "firm": firms, "intensity": q[-1].sum(axis=1), "response": slopes[0], "staged": bool((lifecycle(e, still) == q).all()), "residual": left})

    kind = _kinds(levels)
    return levels.groupBy("economy").applyInPandas(run, f"economy {kind['economy']}, firm {kind['firm']}, intensity double, response double, staged boolean, residual double")
