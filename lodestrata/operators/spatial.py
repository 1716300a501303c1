"""Spatial autoregressions of dated panels on peer fields.

The data enter through Gram blocks that Spark sums over dates; what is optimised on the driver is a function of one or two
parameters and matrices of the size of the roster.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.fields import spatial_lag
from lodestrata.sources.contracts import ContractError, require


def lag_moments(panel: DataFrame, weights: DataFrame, value: str = "return") -> DataFrame:
    """One row: n, dates, sum r^2, sum r Wr, sum (Wr)^2 over all assets and dates."""
    lag = spatial_lag(panel, weights, value).withColumnRenamed("target", "ticker")
    met = panel.join(lag, ["ticker", "Date"])
    r, w = F.col(value), F.col("lag")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Date").alias("dates"), F.sum(r * r).alias("rr"), F.sum(r * w).alias("rw"), F.sum(w * w).alias("ww"))


#: A dense field has at most this number squared of cells (128 MB).
MOST_ASSETS = 4096


def matrix(weights: DataFrame, roster: list[str]) -> np.ndarray:
    """The field as a dense matrix on the driver (roster squared cells)."""
    if len(roster) > MOST_ASSETS:
        raise ContractError(f"a roster of more than {MOST_ASSETS}")
    at = {t: k for k, t in enumerate(roster)}
    out = np.zeros((len(roster), len(roster)))
    for r in weights.select("target", "candidate", "weight").toLocalIterator():
        if r["target"] in at and r["candidate"] in at:
            out[at[r["target"]], at[r["candidate"]]] = r["weight"]
    return out


def log_determinant(rho: float, eigenvalues: np.ndarray) -> float:
    """log |det(I - rho W)|, by the moduli of complex eigenvalues."""
    return float(np.log(np.abs(1 - rho * eigenvalues)).sum())


def maximise(f, low: float, high: float, scan: int = 200, rounds: int = 80) -> tuple[float, float]:
    """The best point of a scan, refined by golden sections around it."""
    grid = np.linspace(low, high, scan)
    k = int(np.argmax([f(x) for x in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, scan - 1)]
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return float(x), float(f(x))


@dataclass
class SpatialFit:
    rho: float
    loglik: float
    sigma2: float
    n: int
    dates: int
    se: float | None = None
    variances: np.ndarray | None = None


def bounds(eigenvalues: np.ndarray, margin: float = 1e-3) -> tuple[float, float]:
    real = eigenvalues[np.abs(eigenvalues.imag) < 1e-9].real
    low = 1 / real.min() if len(real) and real.min() < 0 else -1.0
    return max(low, -1.0) + margin, 1.0 - margin


def sar_qmle(moments, eigenvalues: np.ndarray, standard_error: bool = True) -> SpatialFit:
    """Quasi-maximum likelihood of r = rho W r + e from lag_moments' row, profile over rho.

    With arrays of moments, a number for each asset, every asset has an innovation variance of its own, profiled with the rest.
    """
    n, rr, rw, ww = (np.asarray(moments[k], float) for k in ("n", "rr", "rw", "ww"))
    dates = moments["dates"]
    variances = lambda rho: np.maximum((rr - 2 * rho * rw + rho * rho * ww) / n, 1e-300)

    def profile(rho: float) -> float:
        return float(-0.5 * (n * (np.log(2 * math.pi * variances(rho)) + 1)).sum()) + dates * log_determinant(rho, eigenvalues)

    low, high = bounds(eigenvalues)
    rho, value = maximise(profile, low, high)
    s2 = variances(rho)
    fit = SpatialFit(rho, value, float(s2.mean()), int(n.sum()), dates, variances=s2 if s2.ndim else None)
    if standard_error:
        fit.se = curvature_error(profile, rho, low, high)
    return fit


def curvature_error(profile, at: float, low: float, high: float, step: float = 1e-2) -> float | None:
    """1 / sqrt(-f'') by a central difference; None at a bound or where the curve is not concave."""
    h = min(step, at - low, high - at)
    if h <= 0:
        return None
    curve = (profile(at + h) - 2 * profile(at) + profile(at - h)) / (h * h)
    return float(1 / math.sqrt(-curve)) if curve < 0 else None


def sar_gmm(weights: np.ndarray) -> None:
    """Moment conditions with a constant: a row-stochastic W maps the constant to itself, so the instruments lose rank."""
    one = np.ones(len(weights))
    instruments = np.stack([one, weights @ one, weights @ weights @ one], axis=1)
    rank = np.linalg.matrix_rank(instruments, tol=1e-8)
    raise ValueError(f"instruments have rank {rank} of 3: rho is not identified for a row-stochastic W")


def instrument_moments(weights: DataFrame) -> DataFrame:
    """One row of sums of products of the instruments 1, W1 and WW1 of a field (target, candidate, weight), without its matrix.

    For a row-stochastic field all three are the constant, so the moments have rank one: `instrument_rank`.
    """
    first = weights.groupBy("target").agg(F.sum("weight").alias("a"))
    met = weights.join(first.toDF("candidate", "x"), "candidate")
    both = first.join(met.groupBy("target").agg(F.sum(F.col("weight") * F.col("x")).alias("b")), "target")
    total = lambda x, y, n: F.sum(F.col(x) * F.col(y)).alias(n)
    return both.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), total("a", "a", "aa"), total("a", "b", "ab"), total("b", "b", "bb"))


def instrument_rank(m) -> int:
    """The rank of a row of instrument_moments."""
    return int(np.linalg.matrix_rank(np.array([[m["n"], m["a"], m["b"]], [m["a"], m["aa"], m["ab"]], [m["b"], m["ab"], m["bb"]]], float) / max(m["n"], 1), tol=1e-8))


def factor_residuals(panel: DataFrame, factors: list[str], value: str = "excess", ticker: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """Residuals of each asset's regression on an intercept and factors, and (ticker, coefficients).

    One aggregation gives every asset's normal equations; they are solved in a map over assets.
    """
    import pandas as pd

    cols = [F.lit(1.0), *(F.col(f).cast("double") for f in factors)]
    k = len(cols)
    xx = F.array(*(F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k)))
    xy = F.array(*(F.sum(c * F.col(value)) for c in cols))
    sums = panel.groupBy(ticker).agg(xx.alias("xx"), xy.alias("xy"))

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame({ticker: pdf[ticker], "coefficients": [np.linalg.lstsq(np.reshape(a, (k, k)), np.asarray(b), rcond=None)[0].tolist() for a, b in zip(pdf["xx"], pdf["xy"], strict=True)]})

    kind = panel.schema[ticker].dataType.simpleString()
    beta = sums.mapInPandas(solve, f"{ticker} {kind}, coefficients array<double>")
    fitted = sum((F.col("coefficients")[i] * cols[i] for i in range(k)), F.lit(0.0))
    return panel.join(beta, ticker).withColumn("residual", F.col(value) - fitted).drop("coefficients"), beta


def sar_factor_qmle(panel: DataFrame, weights: DataFrame, factors: list[str], roster: list[str], value: str = "excess", variance: str = "spherical") -> tuple[SpatialFit, DataFrame]:
    """SAR with factors: r and Wr are each taken off intercept and factors by asset, then the profile is that of the residuals.

    variance: spherical, one for all assets, or diagonal, one for each, in the order of the roster. Returns the fit and (ticker,
    coefficients): intercept and loadings at the fitted rho.
    """
    if variance not in ("spherical", "diagonal"):
        raise ValueError(f"variance {variance}: spherical or diagonal")
    lag = spatial_lag(panel, weights, value).withColumnRenamed("target", "ticker")
    both = panel.join(lag, ["ticker", "Date"])
    r, beta = factor_residuals(both, factors, value)
    out, lag_beta = factor_residuals(r.withColumnRenamed("residual", "_r"), factors, "lag")
    a, b = F.col("_r"), F.col("residual")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(a * a).alias("rr"), F.sum(a * b).alias("rw"), F.sum(b * b).alias("ww")]
    eigenvalues = np.linalg.eigvals(matrix(weights, roster))
    if variance == "spherical":
        fit = sar_qmle(out.agg(*sums, F.count_distinct("Date").alias("dates")).first(), eigenvalues)
    else:
        rows = {x["ticker"]: x for x in out.groupBy("ticker").agg(*sums).collect()}  # a row for each asset of the roster
        dates = out.select("Date").distinct().count()
        fit = sar_qmle({"dates": dates} | {k: np.array([rows[t][k] for t in roster], float) for k in ("n", "rr", "rw", "ww")}, eigenvalues)
    both = beta.join(lag_beta.withColumnRenamed("coefficients", "_l"), "ticker")
    return fit, both.select("ticker", F.zip_with("coefficients", "_l", lambda x, y: x - fit.rho * y).alias("coefficients"))


def factor_log_scores(panel: DataFrame, weights: DataFrame, factors: list[str], roster: list, fit: SpatialFit, coefficients: DataFrame, value: str = "excess") -> DataFrame:
    """(Date, score): the held-out Gaussian log density of each date under a factor fit, with its own variance for each asset or one for all."""
    spark = panel.sparkSession
    kind = panel.schema["ticker"].dataType.simpleString()
    own = fit.variances if fit.variances is not None else np.full(len(roster), fit.sigma2)
    spread = F.broadcast(spark.createDataFrame([(t, float(v)) for t, v in zip(roster, own, strict=True)], f"ticker {kind}, _s2 double"))
    lag = spatial_lag(panel, weights, value).withColumnRenamed("target", "ticker")
    fitted = F.col("coefficients")[0] + sum((F.col("coefficients")[k + 1] * F.col(f) for k, f in enumerate(factors)), F.lit(0.0))
    e = F.col(value) - F.lit(fit.rho) * F.col("lag") - fitted
    ld = log_determinant(fit.rho, np.linalg.eigvals(matrix(weights, roster)))
    met = panel.join(lag, ["ticker", "Date"]).join(coefficients, "ticker").join(spread, "ticker")
    return met.groupBy("Date").agg((F.lit(ld) - 0.5 * F.sum(F.log(2 * math.pi * F.col("_s2")) + e * e / F.col("_s2"))).alias("score"))


def daily_log_scores(panel: DataFrame, weights: DataFrame, fit: SpatialFit, eigenvalues: np.ndarray, value: str = "return") -> DataFrame:
    """(Date, score): the held-out Gaussian log density of each date under a fit, without refitting."""
    lag = spatial_lag(panel, weights, value).withColumnRenamed("target", "ticker")
    e = F.col(value) - F.lit(fit.rho) * F.col("lag")
    ld = log_determinant(fit.rho, eigenvalues)
    n = F.count(F.lit(1))
    return panel.join(lag, ["ticker", "Date"]).groupBy("Date").agg((-0.5 * n * math.log(2 * math.pi * fit.sigma2) + F.lit(ld) - F.sum(e * e) / (2 * fit.sigma2)).alias("score"))


def reduced_form(rho: float, weights: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """(I - rho W)^-1 C by a solve."""
    return np.linalg.solve(np.eye(len(weights)) - rho * weights, coefficients)


def two_field_gram(panel: DataFrame, first: DataFrame, second: DataFrame, value: str = "return") -> DataFrame:
    """Sums and 3 x 3 cross products of (r, W1 r, W2 r) by date: (Date, n, s1, s2, s3, g11, g12, g13, g22, g23, g33)."""
    a = spatial_lag(panel, first, value).select(F.col("target").alias("ticker"), "Date", F.col("lag").alias("a"))
    b = spatial_lag(panel, second, value).select(F.col("target").alias("ticker"), "Date", F.col("lag").alias("b"))
    met = panel.join(a, ["ticker", "Date"]).join(b, ["ticker", "Date"])
    z = [F.col(value), F.col("a"), F.col("b")]
    return met.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i + 1}") for i, c in enumerate(z)), *(F.sum(z[i] * z[j]).alias(f"g{i + 1}{j + 1}") for i in range(3) for j in range(i, 3)))


def two_field_qmle(gram: DataFrame, w1: np.ndarray, w2: np.ndarray, theta_grid: int = 21, pinned: float | None = None) -> dict[str, float]:
    """r = rho (theta W1 + (1 - theta) W2) r + e: scan over theta (or pinned), profile over rho."""
    row = gram.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("dates"), *(F.sum(c).alias(c) for c in ("g11", "g12", "g13", "g22", "g23", "g33"))).first()
    g = np.array([[row["g11"], row["g12"], row["g13"]], [row["g12"], row["g22"], row["g23"]], [row["g13"], row["g23"], row["g33"]]])
    best: dict[str, float] = {"loglik": -np.inf}
    thetas = [pinned] if pinned is not None else list(np.linspace(0, 1, theta_grid))
    for _ in range(1 if pinned is not None else 2):
        for theta in thetas:
            mixed = np.linalg.eigvals(theta * w1 + (1 - theta) * w2)
            v = np.array([theta, 1 - theta])
            m = {"n": row["n"], "dates": row["dates"], "rr": g[0, 0], "rw": float(g[0, 1:] @ v), "ww": float(v @ g[1:, 1:] @ v)}
            fit = sar_qmle(m, mixed, standard_error=False)
            if fit.loglik > best["loglik"]:
                best = {"theta": float(theta), "rho": fit.rho, "loglik": fit.loglik, "sigma2": float(fit.sigma2)}
        step = 1 / (theta_grid - 1)
        thetas = [t for t in np.linspace(best["theta"] - step, best["theta"] + step, theta_grid) if 0 <= t <= 1]
    return best


@dataclass
class TwoFieldGrid:
    """Profile points of r = a + rho (theta W1 + (1 - theta) W2) r + e, and log |det| at each, which no draw changes."""

    thetas: np.ndarray
    rhos: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, w1: np.ndarray, w2: np.ndarray, thetas: int = 21, rhos: int = 100, most: float = 0.99) -> TwoFieldGrid:
        t, r = np.linspace(0, 1, thetas), np.linspace(0, most, rhos)
        return cls(t, r, w1, w2, np.array([[log_determinant(x, v) for x in r] for v in (np.linalg.eigvals(a * w1 + (1 - a) * w2) for a in t)]))

    def logdet(self, theta: float, rho: float) -> float:
        sign, value = np.linalg.slogdet(np.eye(len(self.w1)) - rho * (theta * self.w1 + (1 - theta) * self.w2))
        return float(value) if sign > 0 else -math.inf


#: Weights and intensities within this of an end are at it.
AT_END = 1e-6


def two_field_point(m: dict, grid: TwoFieldGrid, refine: bool = True) -> dict[str, float]:
    """The best point of one set of sums (n, dates, s1.., g11..): the grid's best, polished inside its own cell and at both ends of theta.

    The common intercept is concentrated out. A polished point is taken only where it gains, so a joint fit is never below the
    fits of one field on the same grid. at_first, at_second: all weight on one field (never where there is no feedback at all).
    """
    n, dates = float(m["n"]), float(m["dates"])
    s = np.array([m["s1"], m["s2"], m["s3"]], float)
    g = np.array([[m["g11"], m["g12"], m["g13"]], [m["g12"], m["g22"], m["g23"]], [m["g13"], m["g23"], m["g33"]]], float) - np.outer(s, s) / n

    def value(theta, rho, logdet):
        v = np.array([np.ones_like(rho * theta), -rho * theta, -rho * (1 - theta)])
        s2 = np.maximum(np.einsum("i...,ij,j...->...", v, g, v) / n, 1e-300)
        return -0.5 * n * (np.log(2 * math.pi * s2) + 1) + dates * logdet

    exact = lambda theta, rho: float(value(theta, rho, grid.logdet(theta, rho)))
    surface = value(grid.thetas[:, None], grid.rhos[None, :], grid.table)
    a, b = np.unravel_index(int(np.argmax(surface)), surface.shape)
    theta, rho, best = float(grid.thetas[a]), float(grid.rhos[b]), float(surface[a, b])
    span = lambda x, k: (float(x[max(k - 1, 0)]), float(x[min(k + 1, len(x) - 1)]))
    if refine:
        x, y = theta, rho
        for _ in range(6):  # one coordinate at a time, inside the cell
            x = maximise(lambda t: exact(t, y), *span(grid.thetas, a), scan=5, rounds=30)[0]
            y, found = maximise(lambda r: exact(x, r), *span(grid.rhos, b), scan=5, rounds=30)
        if found >= best:
            theta, rho, best = x, y, found
        for k in (0, len(grid.thetas) - 1):
            c = int(np.argmax(surface[k]))
            r, found = maximise(lambda r: exact(grid.thetas[k], r), *span(grid.rhos, c), scan=5, rounds=40)  # noqa: B023
            if found > best:
                theta, rho, best = float(grid.thetas[k]), r, found
    v = np.array([1, -rho * theta, -rho * (1 - theta)])
    return {"theta": theta, "rho": rho, "rho_1": rho * theta, "rho_2": rho * (1 - theta), "loglik": best, "alpha": float(s @ v / n), "sigma2": max(float(v @ g @ v / n), 1e-300), "at_first": bool(rho > AT_END and theta >= 1 - AT_END), "at_second": bool(rho > AT_END and theta <= AT_END)}


GRAM = ("n", "s1", "s2", "s3", "g11", "g12", "g13", "g22", "g23", "g33")
REFIT = "draw long, theta double, rho double, rho_1 double, rho_2 double, loglik double, at_first boolean, at_second boolean"


def two_field_refits(gram: DataFrame, grid: TwoFieldGrid, draws: int, block: float, seed: int, refine: bool = True) -> DataFrame:
    """A fit for each draw of dates: (draw, theta, rho, rho_1, rho_2, loglik, at_first, at_second).

    gram: two_field_gram. A draw is how often it takes each date, on one stationary path that all assets share; multiplied into the
    dates' sums they give the draw's own, and each draw is fitted in a task with the one table of log-determinants.
    """
    from lodestrata.operators.ordered import running_totals
    from lodestrata.operators.resampling import index_table

    spark = gram.sparkSession
    placed = running_totals(gram, [], [F.col("Date")], {"source": F.lit(1)})
    taken = index_table(spark, placed.count(), draws, block, seed).groupBy("draw", "source").agg(F.count(F.lit(1)).alias("_k"))
    sums = taken.join(placed, "source").groupBy("draw").agg(F.sum("_k").alias("dates"), *(F.sum(F.col("_k") * F.col(c)).alias(c) for c in GRAM))
    held = spark.sparkContext.broadcast(grid)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [{"draw": int(r["draw"])} | two_field_point(r, held.value, refine) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in REFIT.split(", ")])

    return sums.repartition(max(1, min(draws, 64)), "draw").mapInPandas(run, REFIT)


def refit_intervals(refits: DataFrame, level: float = 0.95) -> DataFrame:
    """One row: percentile intervals of both channels and of theta, and the shares of draws at either end."""
    from lodestrata.functions.ranks import linear_quantiles

    ends = lambda c: linear_quantiles(c, [(1 - level) / 2, (1 + level) / 2])
    return refits.agg(*(ends(c)[k].alias(f"{c}_{side}") for c in ("rho_1", "rho_2", "theta") for k, side in ((0, "low"), (1, "high"))), F.avg(F.col("at_first").cast("double")).alias("at_first"), F.avg(F.col("at_second").cast("double")).alias("at_second"), F.count(F.lit(1)).alias("draws"))


def likelihood_ratio(joint: float, restricted: float, tolerance: float = 1e-6) -> float:
    """Twice the gain; materially negative is an error, tiny negative is zero."""
    q = 2 * (joint - restricted)
    if q < -tolerance * max(1.0, abs(joint)):
        raise ValueError(f"likelihood ratio {q}")
    return max(q, 0.0)


def nested_bootstrap(returns: np.ndarray, w1: np.ndarray, w2: np.ndarray, pinned: float, draws: int, block: int, seed: int, spark, factors: np.ndarray | None = None) -> tuple[float, float, DataFrame]:
    """Likelihood ratio of theta free against pinned, and its p under the pinned null.

    With factors (dates x factors) every asset's intercept and loadings are profiled out of returns and lags alike, and the null's
    panels keep the fitted ones.

    Standardised null residuals are resampled by independent stationary paths for each asset; every draw refits both models
    in a task of its own. returns: dates x assets.
    """
    import pandas as pd

    from lodestrata.operators.resampling import stationary_indices

    design = None if factors is None else np.column_stack([np.ones(len(returns)), factors])
    basis = None if design is None else np.linalg.qr(design)[0]
    off = lambda y: y if basis is None else y - basis @ (basis.T @ y)

    def fit(r: np.ndarray, theta: float | None) -> dict[str, float]:
        z = np.stack([off(r), off(r @ w1.T), off(r @ w2.T)])
        g = np.einsum("atn,btn->ab", z, z)
        best = {"loglik": -np.inf}
        for t in [theta] if theta is not None else np.linspace(0, 1, 11):
            v = np.array([t, 1 - t])
            m = {"n": r.size, "dates": len(r), "rr": g[0, 0], "rw": float(g[0, 1:] @ v), "ww": float(v @ g[1:, 1:] @ v)}
            f = sar_qmle(m, np.linalg.eigvals(t * w1 + (1 - t) * w2), standard_error=False)
            if f.loglik > best["loglik"]:
                best = {"theta": float(t), "rho": f.rho, "loglik": f.loglik}
        return best

    null, free = fit(returns, pinned), fit(returns, None)
    observed = likelihood_ratio(free["loglik"], null["loglik"])
    a = np.eye(len(w1)) - null["rho"] * (pinned * w1 + (1 - pinned) * w2)
    whole = returns @ a.T
    e = off(whole)
    fitted = whole - e if factors is not None else 0.0
    scale = e.std(axis=0, ddof=1)
    e = (e - e.mean(axis=0)) / scale
    back = np.linalg.inv(a)

    def run(batches):
        for pdf in batches:
            out = []
            for d in pdf["draw"]:
                new = np.stack([e[stationary_indices(len(e), block, np.random.default_rng([seed, int(d), k])), k] for k in range(e.shape[1])], axis=1) * scale
                r = (fitted + new) @ back.T
                out.append(likelihood_ratio(fit(r, None)["loglik"], fit(r, pinned)["loglik"]))
            yield pd.DataFrame({"draw": pdf["draw"], "statistic": out})

    table = spark.range(draws).select(F.col("id").alias("draw")).repartition(max(1, min(draws, 200)), "draw").mapInPandas(run, "draw long, statistic double")
    rows = [r["statistic"] for r in table.collect()]
    return observed, (1 + sum(x >= observed for x in rows)) / (1 + draws), table


def shrunk_covariance(panel: DataFrame, value: str = "return") -> DataFrame:
    """(ticker_i, ticker_j, value, intensity): covariance of a complete panel shrunk towards constant correlation (Ledoit-Wolf).

    Second, and mixed fourth, moments of every pair of assets are sums over dates; target and intensity follow from sums over pairs,
    so no matrix is ever held in one place.
    """
    n, dates = panel.select("ticker").distinct().count(), panel.select("Date").distinct().count()
    require(panel, complete=(F.count(value) == n * dates) & (F.count(F.lit(1)) == n * dates))
    mean = panel.groupBy("ticker").agg(F.avg(value).alias("_m"))
    x = panel.join(mean, "ticker").select("ticker", "Date", (F.col(value) - F.col("_m")).alias("x"))
    a, b = F.col("x"), F.col("y")
    met = x.withColumnRenamed("ticker", "ticker_i").join(x.toDF("ticker_j", "Date", "y"), "Date")
    pairs = met.groupBy("ticker_i", "ticker_j").agg(F.avg(a * b).alias("s"), F.avg(a * a * b * b).alias("p"), F.avg(a * a * a * b).alias("t"))
    own = pairs.where("ticker_i = ticker_j")
    pairs = pairs.join(own.select("ticker_i", F.col("s").alias("ii")), "ticker_i").join(own.select("ticker_j", F.col("s").alias("jj")), "ticker_j")
    off, s, both = F.col("ticker_i") != F.col("ticker_j"), F.col("s"), F.sqrt(F.col("ii") * F.col("jj"))
    phi, theta = F.col("p") - s * s, F.col("t") - F.col("ii") * s
    bar = F.avg(F.when(off, s / both))
    # gamma = sum (bar sd sd - s)^2 off the diagonal, opened up so that one pass gives it whatever bar is
    sums = pairs.agg(bar.alias("bar"), F.sum(phi).alias("phi"), F.sum(F.when(~off, phi)).alias("own"), F.sum(F.when(off, F.sqrt(F.col("jj") / F.col("ii")) * theta)).alias("cross"), F.sum(F.when(off, both * both)).alias("g0"), F.sum(F.when(off, both * s)).alias("g1"), F.sum(F.when(off, s * s)).alias("g2"))
    gamma = F.col("bar") * F.col("bar") * F.col("g0") - 2 * F.col("bar") * F.col("g1") + F.col("g2")
    kappa = (F.col("phi") - F.col("own") - F.col("bar") * F.col("cross")) / F.nullif(gamma, F.lit(0.0))
    scale = sums.select(F.coalesce("bar", F.lit(0.0)).alias("bar"), F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), kappa / dates)), F.lit(0.0)).alias("intensity"))
    target = F.when(off, F.col("bar") * both).otherwise(s)
    return pairs.join(F.broadcast(scale), F.lit(True)).select("ticker_i", "ticker_j", (F.col("intensity") * target + (1 - F.col("intensity")) * s).alias("value"), "intensity")


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance of rows shrunk towards constant correlation, and the intensity."""
    t, n = x.shape
    y = x - x.mean(axis=0)
    s = y.T @ y / t
    sd = np.sqrt(np.diag(s))
    r = s / np.outer(sd, sd)
    rbar = (r.sum() - n) / (n * (n - 1))
    f = rbar * np.outer(sd, sd)
    np.fill_diagonal(f, np.diag(s))
    y2 = y * y
    phi = y2.T @ y2 / t - s * s
    theta = (y2 * y).T @ y / t - np.diag(s)[:, None] * s  # cov of s_ii with s_ij
    off = (sd[None, :] / sd[:, None]) * theta
    rho = np.trace(phi) + rbar * (off.sum() - np.trace(off))
    gamma = ((f - s) ** 2).sum()
    kappa = (phi.sum() - rho) / gamma if gamma > 0 else 0.0
    intensity = max(0.0, min(1.0, kappa / t))
    return intensity * f + (1 - intensity) * s, float(intensity)


def spatial_covariance(rho: float, w: np.ndarray, innovations: np.ndarray, loadings: np.ndarray, factor_covariance: np.ndarray) -> np.ndarray:
    """(I - rho W)^-1 D (I - rho W)^-T plus the systematic part from reduced-form loadings, symmetrised."""
    a = np.eye(len(w)) - rho * w
    d, _ = ledoit_wolf(innovations)
    half = np.linalg.solve(a, d)
    idiosyncratic = np.linalg.solve(a, half.T)
    b = np.linalg.solve(a, loadings)
    total = idiosyncratic + b @ factor_covariance @ b.T
    return (total + total.T) / 2


def gaussian_score(x: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Log density of each row."""
    c = np.linalg.cholesky(covariance)
    z = np.linalg.solve(c, x.T)
    return -0.5 * (len(covariance) * math.log(2 * math.pi) + 2 * np.log(np.diag(c)).sum() + (z * z).sum(axis=0))


def odds(fits: DataFrame) -> DataFrame:
    """rho / (1 - rho) of each cell, and contrasts with the first cell by name."""
    w = Window.partitionBy().orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lam = F.col("rho") / (1 - F.col("rho"))
    return fits.withColumn("lambda", lam).withColumn("contrast", lam - F.first(lam).over(w))


def operator_separation(panel: DataFrame, first: DataFrame, second: DataFrame, value: str = "return") -> DataFrame:
    """Correlation of the weights, correlation of the lags, and the relative standard deviation of their difference."""
    a, b = first.withColumnRenamed("weight", "x"), second.withColumnRenamed("weight", "y")
    w = a.join(b, ["target", "candidate"], "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")).agg(F.corr("x", "y").alias("weight_correlation"))
    s = spatial_lag(panel, first, value).join(spatial_lag(panel, second, value).withColumnRenamed("lag", "other"), ["target", "Date"])
    m = s.agg(F.corr("lag", "other").alias("signal_correlation"), (F.stddev_pop(F.col("lag") - F.col("other")) / F.stddev_pop("lag")).alias("relative_sd"))
    return w.crossJoin(m)
