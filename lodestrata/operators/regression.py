"""Dyadic regression, permutation tests, ordination and small-sample bounds.

Sufficient statistics are aggregated by Spark; what is solved on the driver has the size of the design, never of the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ranks import linear_quantiles
from lodestrata.operators.ordered import running_totals


def normal_equations(df: DataFrame, y: str, x: list[str], weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n of the design (1, x...), in one aggregation."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    w = F.lit(1.0) if weight is None else F.col(weight)
    k = len(cols)
    aggs = [F.sum(w * cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(w * cols[i] * F.col(y)).alias(f"b{i}") for i in range(k)]
    row = df.agg(*aggs, F.sum(w * F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    xx = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return xx, np.array([row[f"b{i}"] for i in range(k)], float), float(row["yy"]), int(row["n"])


def independent(xx: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Columns that are not collinear with earlier ones, by pivots of the scaled cross products."""
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    a, kept = xx / scale[:, None] / scale[None, :], []
    for j in range(len(a)):
        rest = a[j, j]
        if kept:
            rest -= a[j, kept] @ np.linalg.solve(a[np.ix_(kept, kept)], a[kept, j])
        if rest > tolerance:
            kept.append(j)
    return kept


def ols(df: DataFrame, y: str, x: list[str], weight: str | None = None) -> dict[str, object]:
    """Coefficients by name (None where dropped as collinear), sse, r2 and n."""
    xx, xy, yy, n = normal_equations(df, y, x, weight)
    kept = independent(xx)
    beta = np.linalg.solve(xx[np.ix_(kept, kept)], xy[kept])
    sse = float(yy - beta @ xy[kept])
    sst = float(yy - xy[0] ** 2 / xx[0, 0])
    names = ["intercept", *x]
    return {"beta": {names[i]: (float(beta[kept.index(i)]) if i in kept else None) for i in range(len(names))}, "sse": sse, "r2": 1 - sse / sst if sst > 0 else None, "n": n, "parameters": len(kept)}


def ols_table(df: DataFrame, y: str, x: str) -> DataFrame:
    """Simple regression as a table of one row, wholly in Spark."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def _endpoint_system(dyads: DataFrame, columns: list[str], i: str, j: str, weight: str | None):
    """Sums over endpoints: B'B (nodes x nodes) and B'Z (nodes x columns), where B marks both endpoints of each dyad."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    ends = dyads.select(F.explode(F.array(i, j)).alias("node"), w.alias("_w"), *columns)
    sums = ends.groupBy("node").agg(F.sum("_w").alias("_n"), *(F.sum(F.col("_w") * F.col(c)).alias(c) for c in columns)).orderBy("node").collect()
    nodes = {r["node"]: k for k, r in enumerate(sums)}
    b = np.zeros((len(nodes), len(nodes)))
    for r in dyads.groupBy(i, j).agg(F.sum(w).alias("w")).toLocalIterator():
        a, c = nodes[r[0]], nodes[r[1]]
        b[a, c] += r["w"]
        b[c, a] += r["w"]
    b[np.diag_indices(len(nodes))] = [r["_n"] for r in sums]
    return b, np.array([[r[c] for c in columns] for r in sums], float), nodes


def dyadic_regression(dyads: DataFrame, y: str, x: list[str], i: str = "item_i", j: str = "item_j", weight: str | None = None) -> dict[str, object]:
    """y on x with a symmetric effect for each endpoint (Frisch-Waugh-Lovell: the effects are taken out of both sides).

    Only cross products by node reach the driver: the residual cross products are Z'Z - (B'Z)'(B'B)^+ (B'Z).
    """
    columns = [y, *x]
    b, bz, nodes = _endpoint_system(dyads, columns, i, j, weight)
    xx, xy, yy, n = normal_equations(dyads, y, x, weight)
    k = len(x) + 1
    zz = np.empty((k, k))
    zz[0, 0], zz[0, 1:], zz[1:, 0], zz[1:, 1:] = yy, xy[1:], xy[1:], xx[1:, 1:]
    # intercept and endpoint effects together: the intercept lies in the span of the effects (each dyad has two ends)
    left = zz - bz.T @ np.linalg.pinv(b, hermitian=True) @ bz
    kept = independent(left[1:, 1:])
    beta = np.linalg.solve(left[1:, 1:][np.ix_(kept, kept)], left[1:, 0][kept]) if kept else np.zeros(0)
    sse = float(left[0, 0] - beta @ left[1:, 0][kept])
    sst = float(yy - xy[0] ** 2 / xx[0, 0])
    return {"beta": {c: (float(beta[kept.index(q)]) if q in kept else None) for q, c in enumerate(x)}, "sse": sse, "within_r2": 1 - sse / left[0, 0] if left[0, 0] > 0 else None, "r2": 1 - sse / sst if sst > 0 else None, "n": n, "nodes": len(nodes)}


#: Pairs that may come to the driver as a matrix.
MOST_CELLS = 1 << 20
#: The regressors of the published specifications, in order.
LADDER = (("w2",), ("w2", "same_sector"), ("w2", "same_sector", "size_gap", "crisis"), ("w2", "same_sector", "size_gap", "crisis", "abs_log_n_diff", "min_log_n"), ("w2", "same_sector", "size_gap", "crisis", "abs_log_n_diff", "min_log_n", "disp_sum", "disp_gap"))


def model_ladder(dyads: DataFrame, y: str, ladder=LADDER, i: str = "item_i", j: str = "item_j") -> list[dict[str, object]]:
    """Fits of growing specifications over one cached dyad table, and the one with endpoint effects last."""
    have = set(dyads.columns)
    held = dyads.persist()
    try:
        fits = [{"model": k + 1, "controls": list(x), **ols(held, y, list(x))} for k, x in enumerate(ladder) if set(x) <= have]
        return [*fits, {"model": len(ladder) + 1, "controls": [ladder[0][0], "endpoint effects"], **dyadic_regression(held, y, [ladder[0][0]], i, j)}]
    finally:
        held.unpersist()


def partial_r2(df: DataFrame, y: str, focal: str, others: list[str]) -> float:
    """1 - SSE(full) / SSE(without the focal column)."""
    return 1 - ols(df, y, [focal, *others])["sse"] / ols(df, y, others)["sse"]


def leave_one_out(dyads: DataFrame, y: str, x: str, i: str = "item_i", j: str = "item_j") -> DataFrame:
    """(node, beta, delta, sign_flip): the slope of y on x without the dyads that touch each node.

    Totals less each node's own sums: no refit reads the dyads again.
    """
    terms = {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(y)}
    sums = [F.sum(e).alias(n) for n, e in terms.items()]
    whole = dyads.agg(*sums).select(*(F.col(n).alias(n + "_t") for n in terms))
    part = dyads.select(F.explode(F.array(i, j)).alias("node"), x, y).groupBy("node").agg(*sums)
    left = part.join(F.broadcast(whole), F.lit(True)).select("node", *(F.col(n + "_t") for n in terms), *((F.col(n + "_t") - F.col(n)).alias(n) for n in terms))
    slope = lambda s: (F.col("sxy" + s) - F.col("sx" + s) * F.col("sy" + s) / F.col("n" + s)) / (F.col("sxx" + s) - F.col("sx" + s) * F.col("sx" + s) / F.col("n" + s))
    return left.select("node", slope("").alias("beta"), (slope("") - slope("_t")).alias("delta"), (slope("") * slope("_t") < 0).alias("sign_flip"))


def shared_endpoint_statistic(dyads: DataFrame, z: str, i: str = "item_i", j: str = "item_j") -> DataFrame:
    """Mean product of centred z over dyad pairs that share an endpoint, less that over disjoint ones, over the mean square; from node sums alone."""
    mean = dyads.agg(F.avg(z).alias("m"))
    c = dyads.join(F.broadcast(mean), F.lit(True)).withColumn("c", F.col(z) - F.col("m"))
    node = c.select(F.explode(F.array(i, j)).alias("node"), "c").groupBy("node").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count(F.lit(1)).alias("d"))
    a = node.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("shared"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("n_shared"))
    b = c.agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("every"), (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("n_every"), F.avg(F.col("c") * F.col("c")).alias("scale"))
    apart = F.col("shared") / F.col("n_shared") - (F.col("every") - F.col("shared")) / (F.col("n_every") - F.col("n_shared"))
    return a.crossJoin(b).select(F.when(F.col("scale") > 0, apart / F.col("scale")).otherwise(0.0).alias("statistic"))


def residual_scale(dyads: DataFrame, y: str, x: list[str], draws: int = 999, seed: int = 10_042, i: str = "item_i", j: str = "item_j") -> tuple[dict[str, object], DataFrame]:
    """Whether squared studentised residuals go together at shared endpoints: the statistic of them less one, and its permutations.

    Returns statistic, p (with one added), q95 and failure (above q95), and the draws (draw, statistic). The pairs of a roster are
    shared with every task (MOST_CELLS bounds them); each permutation takes endpoint sums in a task of its own.
    """
    _, rows = influence(dyads, y, x)
    z = rows.select(i, j, (F.col("studentised") * F.col("studentised") - 1).alias("z"))
    observed = float(shared_endpoint_statistic(z, "z", i, j).first()["statistic"])
    if z.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs: not a roster")
    held = z.orderBy(i, j).toPandas()
    _, codes = np.unique(np.concatenate([held[i], held[j]]).astype(str), return_inverse=True)
    spark = dyads.sparkSession
    shared = spark.sparkContext.broadcast((held["z"].to_numpy(float), codes[: len(held)], codes[len(held) :]))

    def run(batches):
        z, a, b = shared.value
        c = z - z.mean()
        n, scale, ends = len(c), float((c * c).mean()), np.concatenate([a, b])
        degree = np.bincount(ends)
        n_shared, n_every = float((degree * (degree - 1) / 2).sum()), n * (n - 1) / 2
        square = float((c * c).sum())
        every = (c.sum() ** 2 - square) / 2
        for pdf in batches:
            out = []
            for d in pdf["draw"]:
                new = np.random.default_rng([seed, int(d)]).permutation(c)
                # each dyad is at two nodes, so squares over nodes are twice the squares over dyads
                together = ((np.bincount(ends, np.concatenate([new, new])) ** 2).sum() - 2 * square) / 2
                out.append((together / n_shared - (every - together) / (n_every - n_shared)) / scale if scale > 0 else 0.0)
            yield pd.DataFrame({"draw": pdf["draw"], "statistic": out})

    table = spark.range(draws).select(F.col("id").alias("draw")).repartition(max(1, min(draws, 64)), "draw").mapInPandas(run, "draw long, statistic double")
    row = table.agg(F.count_if(F.col("statistic") >= observed).alias("above"), F.percentile("statistic", F.lit(0.95)).alias("q95")).first()
    return {"statistic": observed, "p": (1 + row["above"]) / (1 + draws), "q95": float(row["q95"]), "failure": bool(observed > row["q95"])}, table


def endpoint_bootstrap(dyads: DataFrame, counts: DataFrame, y: str, x: list[str], i: str = "item_i", j: str = "item_j") -> DataFrame:
    """(draw_id, slopes, within_r2, sse, nodes, dyads, rank, ok): the regression with endpoint effects under each draw of nodes.

    counts (draw_id, ticker, multiplicity); a dyad weighs the product of its ends' multiplicities, and dyads of weight zero go. Each
    draw solves its own weighted incidence system (one row and column for each node drawn) in a task; slopes follow x, null where
    a regressor is collinear with the effects or those before it. Its rows are the pairs of a roster.
    """
    from lodestrata.operators.resampling import dyad_weights

    drawn = dyad_weights(dyads.select(i, j, y, *x), counts, i, j)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(np.concatenate([pdf[i], pdf[j]]), return_inverse=True)
        a, b, w = code[: len(pdf)], code[len(pdf) :], pdf["weight"].to_numpy(float)
        z = pdf[[y, *x]].to_numpy(float)
        laplacian = np.zeros((len(names), len(names)))
        np.add.at(laplacian, (a, b), w)
        np.add.at(laplacian, (b, a), w)
        laplacian[np.diag_indices(len(names))] = np.bincount(code, np.concatenate([w, w]), len(names))
        at_nodes = np.stack([np.bincount(code, np.concatenate([w * c, w * c]), len(names)) for c in z.T], axis=1)
        left = (z * w[:, None]).T @ z - at_nodes.T @ np.linalg.pinv(laplacian, hermitian=True) @ at_nodes
        raw = np.maximum(((z * w[:, None]) * z).sum(axis=0), 1e-300)
        # what is left of a column that the effects span is rounding of its own size
        open_ = [q for q in range(1, len(left)) if left[q, q] > 1e-9 * raw[q]]
        kept = [open_[q] for q in independent(left[np.ix_(open_, open_)])] if open_ else []
        slopes: list[float | None] = [None] * len(x)
        beta = np.linalg.solve(left[np.ix_(kept, kept)], left[kept, 0]) if kept else np.zeros(0)
        for q, v in zip(kept, beta, strict=True):
            slopes[q - 1] = float(v)
        sse = float(left[0, 0] - beta @ left[kept, 0]) if kept else float(left[0, 0])
        r2 = 1 - sse / left[0, 0] if left[0, 0] > 1e-12 * raw[0] else None
        return pd.DataFrame({"draw_id": [key[0]], "slopes": [slopes], "within_r2": [r2], "sse": [sse], "nodes": [len(names)], "dyads": [len(pdf)], "rank": [len(kept)], "ok": [len(kept) == len(x)]})

    return drawn.groupBy("draw_id").applyInPandas(solve, "draw_id long, slopes array<double>, within_r2 double, sse double, nodes long, dyads long, rank long, ok boolean")


def bootstrap_summary(draws: DataFrame, estimate: float, place: int = 0, level: float = 0.95) -> DataFrame:
    """One row: se, t, percentile interval and two-sided p of the slope at a place, over the draws that identify all slopes; valid and requested."""
    from lodestrata.functions.ranks import linear_quantiles

    s = draws.withColumn("_s", F.when(F.col("ok"), F.col("slopes")[place]))
    q = linear_quantiles("_s", [(1 - level) / 2, (1 + level) / 2])
    below, above, n = F.count_if(F.col("_s") <= 0), F.count_if(F.col("_s") >= 0), F.count("_s")
    out = s.agg(F.lit(float(estimate)).alias("estimate"), F.stddev_samp("_s").alias("se"), q[0].alias("low"), q[1].alias("high"), F.least(F.lit(1.0), 2 * (1 + F.least(below, above)) / (1 + n)).alias("p"), n.alias("valid"), F.count(F.lit(1)).alias("requested"))
    return out.withColumn("t", F.col("estimate") / F.nullif(F.col("se"), F.lit(0.0)))


def influence(dyads: DataFrame, y: str, x: list[str]) -> tuple[dict[str, float], DataFrame]:
    """Condition number of the centred, scaled design, and (leverage, studentised, high) of every dyad."""
    fit = ols(dyads, y, x)
    xx, _, _, n = normal_equations(dyads, y, x)
    inverse = np.linalg.pinv(xx)
    p, s2 = fit["parameters"], fit["sse"] / max(n - fit["parameters"], 1)
    d = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    leverage = sum((F.lit(float(inverse[a, b])) * d[a] * d[b] for a in range(len(d)) for b in range(len(d))), F.lit(0.0))
    fitted = F.lit(fit["beta"]["intercept"]) + sum((F.lit(fit["beta"][c] or 0.0) * F.col(c) for c in x), F.lit(0.0))
    rows = dyads.withColumn("leverage", leverage).withColumn("studentised", (F.col(y) - fitted) / F.sqrt(F.lit(s2) * (1 - F.col("leverage")))).withColumn("high", F.col("leverage") > 2 * p / n)
    cov = xx[1:, 1:] / n - np.outer(xx[0, 1:] / n, xx[0, 1:] / n)
    scale = np.sqrt(np.diag(cov))
    return {"condition_number": float(np.sqrt(np.linalg.cond(cov / np.outer(scale, scale)))), "leverage_mean": p / n}, rows


def matrix_of(pairs: DataFrame, value: str = "value", i: str = "item_i", j: str = "item_j") -> tuple[list, np.ndarray]:
    """A symmetric matrix from i < j (or all) pairs, for statistics whose data are the n^2 cells; a missing cell is an error."""
    rows = pairs.select(i, j, value).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs: not a roster")
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at = {n: k for k, n in enumerate(names)}
    out = np.full((len(names), len(names)), np.nan)
    for r in rows:
        a, b = at[r[0]], at[r[1]]
        out[a, b] = out[b, a] = r[2] if math.isnan(out[a, b]) else max(out[a, b], r[2])
    np.fill_diagonal(out, 0.0)
    if np.isnan(out).any():
        raise ValueError("a pair is missing")
    return names, out


def permutations_of(spark, draws: int, seed: int, statistic, tasks: int = 64) -> DataFrame:
    """(draw, statistic): statistic(rng) for each draw, seeded by [seed, draw], spread over tasks."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"draw": pdf["draw"], "statistic": [float(statistic(np.random.default_rng([seed, int(d)]))) for d in pdf["draw"]]})

    return spark.range(draws).select(F.col("id").alias("draw")).repartition(min(tasks, max(1, draws)), "draw").mapInPandas(run, "draw long, statistic double")


def add_one_p(draws: DataFrame, observed: float, tolerance: float = 1e-12, absolute: bool = False) -> float:
    """(1 + draws at least as large) / (1 + draws), ties within tolerance counted."""
    x = F.abs("statistic") if absolute else F.col("statistic")
    seen = abs(observed) if absolute else observed
    r = draws.agg(F.count_if(x >= seen - tolerance * max(1.0, abs(seen))).alias("k"), F.count(F.lit(1)).alias("n")).first()
    return (1 + r["k"]) / (1 + r["n"])


def mantel(x: DataFrame, y: DataFrame, method: str = "pearson", draws: int = 999, seed: int = 42, given: DataFrame | None = None) -> dict[str, float]:
    """Correlation of two distance tables over pairs, by permuting items; partial if a third table is given."""
    names, a = matrix_of(x)
    other, b = matrix_of(y)
    if names != other:
        raise ValueError("rosters differ")
    cells = np.triu_indices(len(names), 1)
    c = matrix_of(given)[1] if given is not None else None
    spark = x.sparkSession

    def score(u: np.ndarray) -> np.ndarray:
        return average_ranks(u) if method == "spearman" else u

    bv = score(b[cells])
    cv = score(c[cells]) if c is not None else None

    def correlation(m: np.ndarray) -> float:
        av = score(m[cells])
        r = np.corrcoef(av, bv)[0, 1]
        if cv is None:
            return r
        ra, rb = np.corrcoef(av, cv)[0, 1], np.corrcoef(bv, cv)[0, 1]
        return (r - ra * rb) / math.sqrt(max((1 - ra * ra) * (1 - rb * rb), 1e-300))

    def drawn(rng):
        p = rng.permutation(len(a))
        return correlation(a[np.ix_(p, p)])

    observed = float(correlation(a))
    return {"statistic": observed, "p": add_one_p(permutations_of(spark, draws, seed, drawn), observed, absolute=True), "draws": draws}


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks with ties at the mean of their places."""
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[inverse]


def permanova_table(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of r2 and pseudo-F from squared distances of pairs i < j, all by sums over pairs. labels: (item, label)."""
    n_g = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    met = pairs.join(labels.toDF("item_i", "l_i"), "item_i").join(labels.toDF("item_j", "l_j"), "item_j").withColumn("sq", F.col("value") * F.col("value"))
    total = met.agg(F.sum("sq").alias("t"))
    within = met.where("l_i = l_j").groupBy(F.col("l_i").alias("label")).agg(F.sum("sq").alias("w")).join(n_g, "label").agg(F.sum(F.col("w") / F.col("n")).alias("w"))
    size = n_g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"))
    one = total.crossJoin(within).crossJoin(size).withColumn("sst", F.col("t") / F.col("n"))
    between = F.col("sst") - F.col("w")
    return one.select((between / F.col("sst")).alias("r2"), (between / (F.col("g") - 1) / (F.col("w") / (F.col("n") - F.col("g")))).alias("pseudo_f"), "n", F.col("g").alias("groups"))


def permanova(pairs: DataFrame, labels: DataFrame, draws: int = 999, seed: int = 42) -> dict[str, float]:
    """Observed pseudo-F and R2, and the add-one p of label permutations."""
    names, d = matrix_of(pairs)
    given = {r[0]: r[1] for r in labels.select("item", "label").collect()}
    code = np.unique([given[n] for n in names], return_inverse=True)[1]
    sq = d * d
    n, g = len(names), code.max() + 1

    def pseudo_f(c: np.ndarray) -> float:
        z = np.eye(g)[c]
        within = (np.einsum("ik,ij,jk->k", z, sq, z) / 2 / z.sum(axis=0)).sum()
        total = sq.sum() / 2 / n
        return ((total - within) / (g - 1)) / (within / (n - g))

    observed = float(pseudo_f(code))
    z = np.eye(g)[code]
    within = float((np.einsum("ik,ij,jk->k", z, sq, z) / 2 / z.sum(axis=0)).sum())
    total = float(sq.sum() / 2 / n)
    p = add_one_p(permutations_of(pairs.sparkSession, draws, seed, lambda rng: pseudo_f(rng.permutation(code))), observed)
    return {"pseudo_f": observed, "r2": (total - within) / total, "p": p}


def pcoa(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates on positive axes (largest first, the largest entry of each positive) and the signed spectrum."""
    sq = d * d
    b = -0.5 * (sq - sq.mean(axis=0)[None, :] - sq.mean(axis=1)[:, None] + sq.mean())
    values, vectors = np.linalg.eigh(b)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    keep = values > 1e-12 * max(abs(values).max(), 1e-300)
    x = vectors[:, keep] * np.sqrt(values[keep])
    return x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])]), values


def inertia(spectrum: DataFrame) -> DataFrame:
    """Running share of positive inertia of (axis, eigenvalue)."""
    positive = F.greatest("eigenvalue", F.lit(0.0))
    whole = spectrum.agg(F.sum(positive)).first()[0]
    return running_totals(spectrum, [], [F.col("axis")], {"_before": positive}).withColumn("cumulative", (F.col("_before") + positive) / F.nullif(F.lit(whole), F.lit(0.0))).drop("_before")


def dispersions(d: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Each item's distance to its group's spatial median in principal coordinates (imaginary axes subtract)."""
    sq = d * d
    b = -0.5 * (sq - sq.mean(axis=0)[None, :] - sq.mean(axis=1)[:, None] + sq.mean())
    values, vectors = np.linalg.eigh(b)
    x, sign = vectors * np.sqrt(np.abs(values)), np.sign(values)

    def median(points: np.ndarray) -> np.ndarray:
        c = points.mean(axis=0)
        for _ in range(100):
            w = 1 / np.maximum(np.sqrt(((points - c) ** 2).sum(axis=1)), 1e-12)
            c = (points * w[:, None]).sum(axis=0) / w.sum()
        return c

    z = np.empty(len(code))
    for g in np.unique(code):
        own = x[code == g]
        z[code == g] = np.sqrt(np.maximum((((own - median(own)) ** 2) * sign).sum(axis=1), 0))
    return z


def dispersion_f(z: np.ndarray, labels: np.ndarray) -> float:
    """F of a one-way layout of z by labels."""
    groups = [z[labels == g] for g in np.unique(labels)]
    between = sum(len(v) * (v.mean() - z.mean()) ** 2 for v in groups) / (len(groups) - 1)
    return float(between / (sum(((v - v.mean()) ** 2).sum() for v in groups) / (len(z) - len(groups))))


def smacof_start(d: np.ndarray, dimensions: int, rounds: int, seed: list[int]) -> tuple[np.ndarray, float, int]:
    """One random start of metric scaling by majorisation: coordinates, raw stress and rounds."""
    n = len(d)
    x, before, k = np.random.default_rng(seed).normal(size=(n, dimensions)), np.inf, 0
    for k in range(rounds):
        e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        stress = float(((d - e)[np.triu_indices(n, 1)] ** 2).sum())
        if before - stress < 1e-10 * max(before if np.isfinite(before) else 1, 1):
            break
        before = stress
        ratio = np.divide(d, e, out=np.zeros_like(d), where=e > 1e-12)
        b = -ratio
        b[np.diag_indices(n)] = ratio.sum(axis=1)
        x = b @ x / n
    return x, stress, k


def contrast_summary(draws: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Mean, quantile interval, share positive and two-sided bootstrap p of finite differences (contrast, difference)."""
    tail = (1 - confidence) / 2
    d = draws.where(F.col("difference").isNotNull() & ~F.isnan("difference") & (F.abs("difference") < float("inf")))
    n = F.count(F.lit(1))
    p = F.least(F.lit(1.0), 2 * F.least((F.count_if(F.col("difference") <= 0) + 1) / (n + 1), (F.count_if(F.col("difference") >= 0) + 1) / (n + 1)))
    q = linear_quantiles("difference", [tail, 1 - tail])
    return d.groupBy("contrast").agg(n.alias("n"), F.avg("difference").alias("mean"), q[0].alias("low"), q[1].alias("high"), F.avg(F.when(F.col("difference") > 0, 1.0).otherwise(0.0)).alias("share_positive"), p.alias("p"))


def paired_contrast(draws: DataFrame, candidate: str, reference: str) -> DataFrame:
    """(draw_id, difference) of two cells' draws that both solved, one to one."""
    a = draws.where((F.col("cell_id") == candidate) & F.col("solve_ok")).select("draw_id", F.col("value").alias("x"))
    b = draws.where((F.col("cell_id") == reference) & F.col("solve_ok")).select("draw_id", F.col("value").alias("y"))
    from lodestrata.sources.contracts import unique

    return unique(a, "draw_id").join(unique(b, "draw_id"), "draw_id").select("draw_id", (F.col("x") - F.col("y")).alias("difference"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for k in (2 * m, 2 * m + 1):
            t = m * (b - m) * x / ((a + k - 1) * (a + k)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def _invert(f, target: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return _invert(lambda x: incomplete_beta(a, b, x), p, 0.0, 1.0)


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    x = beta_quantile(2 * (1 - p), df / 2, 0.5)
    return math.sqrt(df * (1 - x) / x) if x > 0 else math.inf


def mean_lower_bound(n: int, mean: float, sd: float, confidence: float) -> float:
    """One-sided Student lower bound of a mean."""
    return mean - t_quantile(confidence, n - 1) * sd / math.sqrt(n)


def clopper_pearson_lower(successes: int, n: int, confidence: float) -> float:
    """One-sided exact lower bound of a share."""
    return 0.0 if successes == 0 else beta_quantile(1 - confidence, successes, n - successes + 1)


def information_criteria(fits: DataFrame) -> DataFrame:
    """aic, and hqc and bic under dates and firm-days. fits: (loglik, parameters, dates, assets)."""
    k, ll, days = F.col("parameters"), F.col("loglik"), F.col("dates") * F.col("assets")
    hqc = lambda n: -2 * ll + 2 * k * F.log(F.log(n))
    bic = lambda n: -2 * ll + k * F.log(n)
    return fits.withColumns({"aic": -2 * ll + 2 * k, "hqc_dates": hqc(F.col("dates")), "hqc_days": hqc(days), "bic_dates": bic(F.col("dates")), "bic_days": bic(days)})


def linear_gmm(q: np.ndarray, d: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Minimise (q - D b)' W (q - D b) for symmetric positive definite W: (b, criterion)."""
    np.linalg.cholesky(weight)
    a = d.T @ weight @ d
    if np.linalg.matrix_rank(a) < a.shape[0]:
        raise ValueError("not identified")
    b = np.linalg.solve(a, d.T @ weight @ q)
    e = q - d @ b
    return b, float(e @ weight @ e)


def gmm_influence(q: np.ndarray, d: np.ndarray, phi_q: np.ndarray, phi_d: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Influence values of the common slope of q on d (vectors), and its standard error: their variance over N."""
    b = float(d @ weight @ q / (d @ weight @ d))
    values = ((phi_q - b * phi_d) @ weight @ d + phi_d @ weight @ (q - b * d)) / (d @ weight @ d)
    return values, float(np.sqrt(values.var(ddof=1) / len(values)))
