"""Comparisons of fields, orders and universes: factor-conditioned two-field fits, separation of operators, likelihood ratios and their bootstraps.

Cross products and residual moments are summed by Spark; draws are tasks seeded by their own number. What a task holds is dates
times a roster, which `small` checks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import spatial as X
from lodestrata.operators.fields import spatial_lag
from lodestrata.operators.resampling import stationary_indices
from lodestrata.sources.contracts import ContractError, none, require

#: Cells of a matrix that may be brought together: dates times a roster, or a roster squared.
MOST_CELLS = 1 << 26


def small(rows: int, columns: int) -> None:
    """Refuse a matrix that is no longer the size of a roster."""
    if rows * columns > MOST_CELLS:
        raise ContractError(f"{rows} x {columns} cells are too many for one task")


def skewness(draws: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, skewness): population skewness of the finite draws; null with fewer than three, or where they vary no more than rounding."""
    x = F.col(value)
    kept = draws.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # variation below the resolution of the mean is rounding
    sums = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.skewness(value).alias("_g"), F.var_pop(value).alias("_v"), F.avg(value).alias("_m"), (F.max(value) - F.min(value)).alias("_range"))
    resolved = (F.col("n") >= 3) & (F.col("_range") > 0) & (F.sqrt("_v") > F.lit(2.220446049250313e-16) * F.abs("_m"))
    groups = draws.select(*by).distinct() if by else None
    out = sums.select(*by, "n", F.when(resolved, F.col("_g")).alias("skewness"))
    return out if groups is None else groups.join(out, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def accumulated(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., count, mean, m2, low, high): the state of an accumulator of moments."""
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"), F.min(value).alias("low"), F.max(value).alias("high"))


def merged_moments(states: DataFrame, by: list[str]) -> DataFrame:
    """The accumulators of coarser groups from those of finer ones: sums of squares within plus those between the means."""
    n, m = F.col("count"), F.col("mean")
    total = F.sum(n)
    # the spread between means is taken about the common mean, in a second sum, which loses no digits
    centre = states.groupBy(*by).agg((F.sum(n * m) / total).alias("_c"))
    met = states.join(centre, by) if by else states.crossJoin(F.broadcast(centre))
    return met.groupBy(*by).agg(total.alias("count"), F.first("_c").alias("mean"), (F.sum("m2") + F.sum(n * (m - F.col("_c")) * (m - F.col("_c")))).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))


def residuals(panel: DataFrame, factors: list[str], columns: list[str], ticker: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """Each column less its regression on an intercept and factors by asset, and (ticker, coefficients by column).

    One aggregation gives every asset's normal equations; a rank that is not full is an error.
    """
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in factors)]
    k = len(x)
    xx = F.array(*(F.sum(x[i] * x[j]) for i in range(k) for j in range(k)))
    xy = F.array(*(F.sum(c * F.col(y)) for y in columns for c in x))
    sums = panel.groupBy(ticker).agg(xx.alias("xx"), xy.alias("xy"))

    def solve(batches):
        for pdf in batches:
            out = []
            for a, b in zip(pdf["xx"], pdf["xy"], strict=True):
                a = np.reshape(a, (k, k))
                if np.linalg.matrix_rank(a) < k:
                    raise ValueError("the factors are collinear")
                out.append(np.linalg.solve(a, np.reshape(b, (len(columns), k)).T).T.ravel().tolist())
            yield pd.DataFrame({ticker: pdf[ticker], "_beta": out})

    kind = panel.schema[ticker].dataType.simpleString()
    beta = sums.mapInPandas(solve, f"{ticker} {kind}, _beta array<double>")
    fitted = lambda q: sum((F.col("_beta")[q * k + i] * x[i] for i in range(k)), F.lit(0.0))
    out = panel.join(beta, ticker).withColumns({y: F.col(y) - fitted(q) for q, y in enumerate(columns)}).drop("_beta")
    coefficients = beta.select(ticker, *(F.slice("_beta", q * k + 1, k).alias(y) for q, y in enumerate(columns)))
    return out, coefficients


def with_lags(panel: DataFrame, fields: dict[str, DataFrame], value: str) -> DataFrame:
    """panel with the lag of value under each field as a column."""
    for name, w in fields.items():
        lag = spatial_lag(panel.select("ticker", "Date", value), w, value)
        panel = panel.join(lag.select(F.col("target").alias("ticker"), "Date", F.col("lag").alias(name)), ["ticker", "Date"])
    return panel


def factor_two_field_qmle(panel: DataFrame, first: DataFrame, second: DataFrame, factors: list[str], roster: list, value: str = "excess", pinned: float | None = None) -> tuple[dict[str, float], DataFrame]:
    """r = rho (theta W1 + (1 - theta) W2) r + factors + e: the fit, and (ticker, coefficients) of the nuisances under it.

    r and both lags are taken off intercept and factors by asset, in one pass; their cross products then profile out rho and theta.
    """
    small(len(roster), len(roster))
    both = with_lags(panel, {"_a": first, "_b": second}, value)
    left, beta = residuals(both, factors, [value, "_a", "_b"])
    z = [F.col(value), F.col("_a"), F.col("_b")]
    gram = left.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), *(F.sum(z[i] * z[j]).alias(f"g{i + 1}{j + 1}") for i in range(3) for j in range(i, 3)))
    fit = X.two_field_qmle(gram, X.matrix(first, roster), X.matrix(second, roster), pinned=pinned)
    one, two = fit["rho"] * fit["theta"], fit["rho"] * (1 - fit["theta"])
    coefficients = F.zip_with(F.zip_with(F.col(value), F.col("_a"), lambda r, a: r - one * a), F.col("_b"), lambda r, b: r - two * b)
    return fit | {"rho_1": one, "rho_2": two}, beta.select("ticker", coefficients.alias("coefficients"))


def factor_two_field_scores(panel: DataFrame, first: DataFrame, second: DataFrame, factors: list[str], roster: list, fit: dict[str, float], coefficients: DataFrame, value: str = "excess") -> DataFrame:
    """(Date, score): the held-out Gaussian log density of each date under a fit, without refitting."""
    n = len(roster)
    sign, logdet = np.linalg.slogdet(np.eye(n) - fit["rho_1"] * X.matrix(first, roster) - fit["rho_2"] * X.matrix(second, roster))
    if sign <= 0:
        raise ContractError("the operator has no positive determinant")
    both = with_lags(panel, {"_a": first, "_b": second}, value).join(coefficients, "ticker")
    fitted = F.col("coefficients")[0] + sum((F.col("coefficients")[i + 1] * F.col(f) for i, f in enumerate(factors)), F.lit(0.0))
    e = F.col(value) - fit["rho_1"] * F.col("_a") - fit["rho_2"] * F.col("_b") - fitted
    k = F.count(F.lit(1))
    return both.groupBy("Date").agg((F.lit(float(logdet)) - 0.5 * (k * math.log(2 * math.pi * fit["sigma2"]) + F.sum(e * e) / fit["sigma2"])).alias("score"))


def separation(panel: DataFrame, first: DataFrame, second: DataFrame, value: str = "return", factors: list[str] | None = None, tolerance: float = 1e-8, least_correlation: float = 0.95, most_difference: float = 0.25) -> DataFrame:
    """How far two fields differ, as one row: their weights off the diagonal, their supports, their rows, and the signals they induce.

    With factors the signals are also compared after taking them off intercept and factors. weak: both rules hold, high correlation
    and a small relative spread of the difference.
    """
    items = first.select("target").union(first.select("candidate")).union(second.select("target")).union(second.select("candidate")).distinct()
    grid = items.toDF("target").join(items.toDF("candidate"), F.col("target") != F.col("candidate"))
    x, y = first.select("target", "candidate", F.col("weight").alias("x")), second.select("target", "candidate", F.col("weight").alias("y"))
    w = grid.join(x, ["target", "candidate"], "left").join(y, ["target", "candidate"], "left").select("target", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    d = F.col("y") - F.col("x")
    a, b = F.col("x") > tolerance, F.col("y") > tolerance
    off = w.agg(F.corr("x", "y").alias("weight_correlation"), F.avg(F.abs(d)).alias("mean_absolute_difference"), F.sqrt(F.avg(d * d)).alias("rms_difference"), (F.count_if(a & b) / F.count_if(a | b)).alias("support_jaccard"))
    # a row has a zero on the diagonal in both fields, which its correlation counts
    diagonal = items.select("target", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    row = w.unionByName(diagonal).groupBy("target").agg(F.corr("x", "y").alias("c"))
    rows = row.agg(F.min("c").alias("row_minimum"), F.median("c").alias("row_median"), F.max("c").alias("row_maximum"))
    names = ["signal_correlation", "signal_difference_sd", "signal_sd"]
    signal = lambda s: s.agg(F.corr("_a", "_b").alias(names[0]), F.stddev_samp(F.col("_b") - F.col("_a")).alias(names[1]), F.stddev_samp("_b").alias(names[2]))
    both = with_lags(panel, {"_a": first, "_b": second}, value)
    out = off.crossJoin(rows).crossJoin(signal(both)).withColumn("relative_difference_sd", F.col("signal_difference_sd") / F.col("signal_sd"))
    if factors is not None:
        left, _ = residuals(both, factors, ["_a", "_b"])
        out = out.crossJoin(signal(left).select(F.col(names[0]).alias("residual_correlation"), (F.col(names[1]) / F.col(names[2])).alias("residual_relative_difference_sd")))
    # one row of sums: it is worked out once, and checked
    row = out.first()
    if not row["signal_sd"] or row["signal_sd"] <= 0:
        raise ContractError("the induced signal has no spread")
    held = panel.sparkSession.createDataFrame([tuple(row)], out.schema)
    return held.withColumn("weak", (F.col("signal_correlation") >= least_correlation) & (F.col("relative_difference_sd") <= most_difference))


def bridge(panel: DataFrame, later: DataFrame, small_field: DataFrame, large_field: DataFrame, short_end, value: str = "return", tolerance: float = 1e-12) -> DataFrame:
    """(cell, assets, dates, rho, loglik, lambda): the small universe over the long and the short horizon, and the large one over the short.

    panel: the large universe's returns; later: the small universe's own, which reach further. Their common part must agree within
    tolerance. lambda = rho / (1 - rho).
    """
    spark = panel.sparkSession
    members = small_field.select(F.col("target").alias("ticker")).distinct()
    short = later.where(F.col("Date") <= F.lit(short_end))
    ours = panel.join(members, "ticker", "left_semi").where(F.col("Date") <= F.lit(short_end)).select("ticker", "Date", F.col(value).alias("_x"))
    met = ours.join(short.select("ticker", "Date", F.col(value).alias("_y")), ["ticker", "Date"], "full")
    require(met, common=none(F.col("_x").isNull() | F.col("_y").isNull() | (F.abs(F.col("_x") - F.col("_y")) > tolerance)))
    cells, rows = {"small_long": (later, small_field), "small_short": (short, small_field), "large_short": (panel.where(F.col("Date") <= F.lit(short_end)), large_field)}, []
    for name, (p, w) in cells.items():
        roster = sorted(r[0] for r in w.select("target").distinct().collect())
        small(len(roster), len(roster))
        mean = p.groupBy("ticker").agg(F.avg(value).alias("_m"))
        centred = p.join(mean, "ticker").withColumn(value, F.col(value) - F.col("_m")).drop("_m")
        fit = X.sar_qmle(X.lag_moments(centred, w, value).first(), np.linalg.eigvals(X.matrix(w, roster)), standard_error=False)
        rows.append((name, len(roster), int(fit.dates), float(fit.rho), float(fit.loglik), float(fit.rho / (1 - fit.rho))))
    return spark.createDataFrame(rows, "cell string, assets int, dates int, rho double, loglik double, lambda double")


def bridge_contrasts(cells: DataFrame) -> DataFrame:
    """(contrast, rho, lambda): long less short horizon of the small universe, and large less small universe at the short one."""
    at = lambda c, x: F.max(F.when(F.col("cell") == c, F.col(x)))
    pairs = {"horizon_long_minus_short": ("small_long", "small_short"), "universe_large_minus_small": ("large_short", "small_short")}
    both = [cells.agg(F.lit(n).alias("contrast"), *((at(a, x) - at(b, x)).alias(x) for x in ("rho", "lambda"))) for n, (a, b) in pairs.items()]
    return both[0].unionByName(both[1])


def grid_of(panel: DataFrame, roster: list, columns: list[str], date: str = "Date") -> list[np.ndarray]:
    """Dates x roster matrices of columns, on the driver: a complete panel of the size of a roster, checked."""
    n = panel.select(date).distinct().count()
    small(n * len(columns), len(roster))
    at = {t: k for k, t in enumerate(roster)}
    rows = panel.groupBy(date).agg(F.array_sort(F.collect_list(F.struct("ticker", *columns))).alias("r")).orderBy(date).toLocalIterator()
    out = [np.full((n, len(roster)), np.nan) for _ in columns]
    for k, r in enumerate(rows):
        for s in r["r"]:
            if s["ticker"] in at:
                for m, c in zip(out, columns, strict=True):
                    m[k, at[s["ticker"]]] = s[c]
    if any(np.isnan(m).any() for m in out):
        raise ContractError("the panel has gaps")
    return out


def profiled(r: np.ndarray, lag: np.ndarray | None, design: np.ndarray, eigenvalues: np.ndarray | None, diagonal: bool = False) -> X.SpatialFit:
    """Factor-conditioned fit of one panel: spatial, or factors alone (lag None); diagonal: a variance for each asset."""
    project = lambda y: y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    over = (lambda y: y.sum(axis=0)) if diagonal else (lambda y: float(y.sum()))
    e = project(r)
    n, dates = (np.full(r.shape[1], len(r), float) if diagonal else r.size), len(r)
    if lag is None:
        s2 = np.maximum(over(e * e) / n, 1e-300)
        return X.SpatialFit(0.0, float(-0.5 * (n * (np.log(2 * math.pi * s2) + 1)).sum()), float(np.mean(s2)), r.size, dates, variances=s2 if diagonal else None)
    w = project(lag)
    return X.sar_qmle({"n": n, "dates": dates, "rr": over(e * e), "rw": over(e * w), "ww": over(w * w)}, eigenvalues, standard_error=False)


def spatial_value(spark: SparkSession, returns: np.ndarray, factors: np.ndarray, fields: dict[str, np.ndarray], draws: int, block: float, seed: int, diagonal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Likelihood ratios of each field's spatial fit over factors alone: (operator, qlr, rho, p), and the null's (draw, operator, qlr, rho).

    The null panel is the factor fit plus its standardised residuals, resampled by a stationary path of each asset's own and
    scaled back (by one spread for all, or with diagonal each asset's own); every draw refits all models in a task. p counts draws at
    least as large, with one added.
    """
    t, n = returns.shape
    small(t, n)
    design = np.column_stack([np.ones(t), factors])
    values = {k: np.linalg.eigvals(w) for k, w in fields.items()}
    null = profiled(returns, None, design, None, diagonal)
    fitted = design @ np.linalg.lstsq(design, returns, rcond=None)[0]
    e = returns - fitted
    e = e - e.mean(axis=0)
    standard = e / np.sqrt(np.maximum((e * e).mean(axis=0), 1e-300))
    held = spark.sparkContext.broadcast((fitted, standard, design, fields, values, np.sqrt(null.variances) if diagonal else math.sqrt(null.sigma2)))

    def ratios(r, design, fields, values):
        alone = profiled(r, None, design, None, diagonal)
        for k, w in fields.items():
            fit = profiled(r, r @ w.T, design, values[k], diagonal)
            yield k, X.likelihood_ratio(fit.loglik, alone.loglik), fit.rho

    def run(batches):
        fitted, standard, design, fields, values, scale = held.value
        for pdf in batches:
            rows = []
            for d in pdf["draw"]:
                new = np.stack([standard[stationary_indices(len(standard), block, np.random.default_rng([seed, int(d), k])), k] for k in range(standard.shape[1])], axis=1)
                rows += [(int(d), *x) for x in ratios(fitted + new * scale, design, fields, values)]
            yield pd.DataFrame(rows, columns=["draw", "operator", "qlr", "rho"])

    table = spark.range(draws).select(F.col("id").alias("draw")).repartition(max(1, min(draws, 200)), "draw").mapInPandas(run, "draw long, operator string, qlr double, rho double")
    observed = spark.createDataFrame([(k, float(q), float(rho)) for k, q, rho in ratios(returns, design, fields, values)], "operator string, observed double, rho double")
    met = table.select("operator", "qlr").join(F.broadcast(observed), "operator")
    summary = met.groupBy("operator").agg(F.first("observed").alias("qlr"), F.first("rho").alias("rho"), ((1 + F.count_if(F.col("qlr") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))
    return summary, table


def spatial_value_draws(spark: SparkSession, calibration: tuple[np.ndarray, np.ndarray], evaluation: tuple[np.ndarray, np.ndarray], fields: dict[str, np.ndarray], draws: int, block: float, seed: int, diagonal: bool = False) -> DataFrame:
    """(draw, operator, rho, score, gain): refits on paired date draws; score is the calibration fit's mean log density of the evaluation draw.

    Calibration and evaluation have schedules of their own, shared by all models, so gain, the score less that of factors alone, is
    paired by draw. calibration and evaluation: returns and factors, dates in rows.
    """
    small(*calibration[0].shape)
    small(*evaluation[0].shape)
    values = {k: np.linalg.eigvals(w) for k, w in fields.items()}
    held = spark.sparkContext.broadcast((calibration, evaluation, fields, values))

    def density(fit, design_fit, r_fit, lag_fit, r, lag, design, ev):
        y = r_fit if lag_fit is None else r_fit - fit.rho * lag_fit
        beta = np.linalg.lstsq(design_fit, y, rcond=None)[0]
        e = (r if lag is None else r - fit.rho * lag) - design @ beta
        ld = 0.0 if ev is None else X.log_determinant(fit.rho, ev)
        s2 = fit.variances if diagonal else np.full(r.shape[1], fit.sigma2)
        return float((ld - 0.5 * (np.log(2 * math.pi * s2) + e * e / s2).sum(axis=1)).mean())

    def run(batches):
        (rc, fc), (re, fe), fields, values = held.value
        for pdf in batches:
            rows = []
            for d in pdf["draw"]:
                i = stationary_indices(len(rc), block, np.random.default_rng([seed, int(d), 0]))
                j = stationary_indices(len(re), block, np.random.default_rng([seed, int(d), 1]))
                dc, de = np.column_stack([np.ones(len(i)), fc[i]]), np.column_stack([np.ones(len(j)), fe[j]])
                alone = density(profiled(rc[i], None, dc, None, diagonal), dc, rc[i], None, re[j], None, de, None)
                rows.append((int(d), "none", 0.0, alone, 0.0))
                for k, w in fields.items():
                    fit = profiled(rc[i], rc[i] @ w.T, dc, values[k], diagonal)
                    score = density(fit, dc, rc[i], rc[i] @ w.T, re[j], re[j] @ w.T, de, values[k])
                    rows.append((int(d), k, fit.rho, score, score - alone))
            yield pd.DataFrame(rows, columns=["draw", "operator", "rho", "score", "gain"])

    return spark.range(draws).select(F.col("id").alias("draw")).repartition(max(1, min(draws, 200)), "draw").mapInPandas(run, "draw long, operator string, rho double, score double, gain double")
