"""Ranks by ranges, bootstraps, permutations, refits and projections against plain versions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import ranks
from lodestrata.operators import moments, ordered, regression, resampling, spatial
from lodestrata.sources.contracts import ContractError


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000, p=[0.7, 0.2, 0.1]), "v": rng.integers(0, 200, 3000).astype(float), "a": rng.integers(0, 9, 3000), "x": rng.normal(size=3000), "id": np.arange(3000)})
    p.loc[:999, "v"] = 7.0  # a third of the rows are one value
    return p, spark.createDataFrame(p).repartition(7)


def test_running_totals_and_ranks_over_ranges(values):
    p, d = values
    got = ordered.running_totals(d, ["g"], [F.col("v").desc(), F.col("id")], {"s": F.col("a"), "t": F.col("x"), "place": F.lit(1)}).toPandas()
    q = p.sort_values(["v", "id"], ascending=[False, True])
    by = q.groupby("g", dropna=False)
    q = q.assign(s=by.a.cumsum() - q.a, t=by.x.cumsum() - q.x, place=by.cumcount())
    m = got.merge(q, on="id", suffixes=("", "_w"))
    assert len(m) == 3000 and (m.s == m.s_w).all() and (m.place == m.place_w).all() and np.allclose(m.t, m.t_w)
    r = ordered.average_ranks(d, "v", "r", ["g"]).toPandas().merge(p.assign(w=p.groupby("g", dropna=False).v.rank()), on="id")
    assert len(r) == 3000 and (r.r == r.w).all()
    top = ordered.running_maximum(d, [F.col("id")], F.col("x"), "top").toPandas().sort_values("id")
    assert np.allclose(top.top, np.maximum.accumulate(p.x))


def test_ranks_of_empty_tables_and_nulls(spark):
    d = spark.createDataFrame([(1, None), (2, 3.0), (3, 3.0), (4, float("nan"))], "id long, v double")
    assert {r["id"]: r["r"] for r in ordered.average_ranks(d, "v", "r").collect()} == {1: None, 2: 1.5, 3: 1.5, 4: 3.0}
    assert ordered.average_ranks(d.limit(0), "v", "r").count() == 0 and ranks.holm(d.limit(0), "v").count() == 0


def test_holm_is_stepwise(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.03, 0.9, 0.001, 0.04]
    got = [r["p_holm"] for r in ranks.holm(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").orderBy("i").collect()]
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    want, top = {}, 0.0
    for k, (x, i) in enumerate(known):
        top = max(top, min(1.0, (len(known) - k) * x))
        want[i] = top
    first = {x: want[i] for x, i in reversed(known)}  # of equal values the first has the largest step
    assert [x is None for x in got] == [x is None for x in p]
    assert [x for x in got if x is not None] == pytest.approx([first[x] for x in p if x is not None])


@pytest.fixture(scope="module")
def dyads(spark):
    rng = np.random.default_rng(3)
    names = [f"n{k}" for k in range(9)]
    e = dict(zip(names, rng.normal(size=9), strict=True))
    rows = [(a, b, float(x), float(z), float(2 * x - z + e[a] + e[b] + 0.3 * rng.normal())) for a, b in itertools.combinations(names, 2) for x, z in [rng.normal(size=2)]]
    return names, pd.DataFrame(rows, columns=["item_i", "item_j", "x", "z", "y"]), spark.createDataFrame(rows, "item_i string, item_j string, x double, z double, y double")


def test_endpoint_bootstrap_is_weighted_least_squares_with_dummies(spark, dyads):
    names, p, d = dyads
    counts = resampling.node_counts(spark, names, 12, 5)
    m = {(r["draw_id"], r["ticker"]): r["multiplicity"] for r in counts.collect()}
    one = spark.createDataFrame([(99, n, 1) for n in names], "draw_id long, ticker string, multiplicity long")
    got = {r["draw_id"]: r for r in regression.endpoint_bootstrap(d, counts.unionByName(one), "y", ["x", "z"]).collect()}
    for draw, r in got.items():
        w = np.array([1.0 if draw == 99 else m[draw, a] * m[draw, b] for a, b in zip(p.item_i, p.item_j, strict=True)])
        own = p[w > 0]
        design = np.column_stack([own.x, own.z, *[(own.item_i == n) | (own.item_j == n) for n in names if ((own.item_i == n) | (own.item_j == n)).any()]]).astype(float)
        root = np.sqrt(w[w > 0])
        beta, _, rank, _ = np.linalg.lstsq(design * root[:, None], own.y.to_numpy() * root, rcond=None)
        left = own.y.to_numpy() - design @ beta
        assert r["sse"] == pytest.approx(float((w[w > 0] * left**2).sum()), abs=1e-8) and r["dyads"] == (w > 0).sum()
        if r["ok"]:
            assert r["slopes"] == pytest.approx(beta[:2], abs=1e-7)
    point = regression.dyadic_regression(d, "y", ["x", "z"])["beta"]
    assert got[99]["slopes"] == pytest.approx([point["x"], point["z"]]) and sum(r["ok"] for r in got.values()) > 6
    s = regression.bootstrap_summary(regression.endpoint_bootstrap(d, resampling.node_counts(spark, names, 60, 1), "y", ["x"]), point["x"]).first()
    assert s["low"] < 2 < s["high"] and 0 < s["se"] < 2 and s["valid"] <= s["requested"] == 60


def test_a_regressor_in_the_span_of_the_effects_has_no_slope(spark, dyads):
    names, p, d = dyads
    at = F.create_map(*itertools.chain.from_iterable((F.lit(n), F.lit(float(k * k))) for k, n in enumerate(names)))
    d = d.withColumn("sum", at[F.col("item_i")] + at[F.col("item_j")])
    one = spark.createDataFrame([(0, n, 1) for n in names], "draw_id long, ticker string, multiplicity long")
    r = regression.endpoint_bootstrap(d, one, "y", ["sum", "x"]).first()
    assert r["slopes"][0] is None and not r["ok"] and r["rank"] == 1


def test_residual_scale_permutes_the_residuals(dyads):
    names, p, d = dyads
    found, draws = regression.residual_scale(d, "y", ["x"], draws=40, seed=7)
    x = np.column_stack([np.ones(len(p)), p.x])
    beta = np.linalg.lstsq(x, p.y, rcond=None)[0]
    h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    e = p.y - x @ beta
    z = (e**2 / ((e @ e) / (len(p) - 2) * (1 - h)) - 1).to_numpy()

    def statistic(z):
        c = z - z.mean()
        shared = [(i, j) for i, j in itertools.combinations(range(len(c)), 2) if {p.item_i[i], p.item_j[i]} & {p.item_i[j], p.item_j[j]}]
        apart = [(i, j) for i, j in itertools.combinations(range(len(c)), 2) if not {p.item_i[i], p.item_j[i]} & {p.item_i[j], p.item_j[j]}]
        return (np.mean([c[i] * c[j] for i, j in shared]) - np.mean([c[i] * c[j] for i, j in apart])) / (c @ c / len(c))

    assert found["statistic"] == pytest.approx(statistic(z))
    own = {r["draw"]: r["statistic"] for r in draws.collect()}
    order = p.sort_values(["item_i", "item_j"]).index
    for k in range(5):
        new = np.empty(len(z))
        new[order] = np.random.default_rng([7, k]).permutation(z[order] - z.mean())
        assert own[k] == pytest.approx(statistic(new))
    assert found["p"] == (1 + sum(s >= found["statistic"] for s in own.values())) / 41


def panel_of(spark, rho, spread, dates=240, n=6, seed=4):
    rng = np.random.default_rng(seed)
    w = (np.ones((n, n)) - np.eye(n)) / (n - 1)
    f = rng.normal(size=dates)
    r = (rng.normal(size=(dates, n)) * spread + 0.1 + np.outer(f, np.linspace(0.5, 1, n))) @ np.linalg.inv(np.eye(n) - rho * w).T
    rows = [(f"t{k}", t, float(r[t, k]), float(f[t])) for t in range(dates) for k in range(n)]
    field = [(f"t{a}", f"t{b}", float(w[a, b])) for a in range(n) for b in range(n) if a != b]
    return r, w, spark.createDataFrame(rows, "ticker string, Date int, excess double, MKT double"), spark.createDataFrame(field, "target string, candidate string, weight double")


def test_diagonal_variances(spark):
    spread = np.array([0.2, 0.5, 1, 2, 3, 4])
    _, _, p, w = panel_of(spark, 0.4, spread)
    roster = [f"t{k}" for k in range(6)]
    own, beta = spatial.sar_factor_qmle(p, w, ["MKT"], roster, variance="diagonal")
    one, _ = spatial.sar_factor_qmle(p, w, ["MKT"], roster)
    assert own.rho == pytest.approx(0.4, abs=0.06) and own.loglik > one.loglik + 50 and np.sqrt(own.variances) == pytest.approx(spread, rel=0.2)
    own_scores, one_scores = (spatial.factor_log_scores(p, w, ["MKT"], roster, f, b).agg(F.sum("score")).first()[0] for f, b in ((own, beta), (one, _)))
    assert own_scores == pytest.approx(own.loglik, rel=1e-9) and one_scores == pytest.approx(one.loglik, rel=1e-9)
    with pytest.raises(ValueError):
        spatial.sar_factor_qmle(p, w, ["MKT"], roster, variance="full")


def test_two_field_refits_are_fits_of_the_drawn_panel(spark):
    r, w1, p, first = panel_of(spark, 0.5, 1.0, dates=60)
    n = len(w1)
    w2 = np.eye(n)[[1, 0, 3, 2, 5, 4]]
    second = spark.createDataFrame([(f"t{a}", f"t{a ^ 1}", 1.0) for a in range(n)], "target string, candidate string, weight double")
    gram = spatial.two_field_gram(p, first, second, "excess")
    grid = spatial.TwoFieldGrid.of(w1, w2, 11, 50)
    plain = {x["draw"]: x for x in spatial.two_field_refits(gram, grid, 6, 5, 3, refine=False).collect()}
    fine = {x["draw"]: x for x in spatial.two_field_refits(gram, grid, 6, 5, 3).collect()}
    for d in range(6):
        own = r[resampling.stationary_indices(60, 5, np.random.default_rng([3, d]))]

        def loglik(theta, rho):
            w = theta * w1 + (1 - theta) * w2
            e = own - rho * own @ w.T
            e = e - e.mean()
            return -0.5 * e.size * (np.log(2 * np.pi * (e**2).mean()) + 1) + 60 * np.log(abs(np.linalg.det(np.eye(n) - rho * w)))

        best = max((loglik(t, x), t, x) for t in grid.thetas for x in grid.rhos)
        assert (plain[d]["loglik"], plain[d]["theta"], plain[d]["rho"]) == pytest.approx(best)
        f = fine[d]
        assert f["loglik"] >= best[0] - 1e-9 and f["loglik"] == pytest.approx(loglik(f["theta"], f["rho"]))
        near = [loglik(min(max(f["theta"] + a, 0), 1), f["rho"] + b) for a in (-1e-3, 0, 1e-3) for b in (-1e-3, 0, 1e-3)]
        assert f["loglik"] >= max(near) - 1e-4 and f["rho_1"] == pytest.approx(f["rho"] * f["theta"])
        assert f["at_first"] == (f["rho"] > 1e-6 and f["theta"] >= 1 - 1e-6)
    s = spatial.refit_intervals(spatial.two_field_refits(gram, grid, 6, 5, 3)).first()
    assert s["draws"] == 6 and s["rho_1_low"] <= s["rho_1_high"]


def cells_of(spark, x, y):
    t, n, _ = x.shape
    return spark.createDataFrame([(k, i, j, float(x[k, i, j]), float(y[k, i, j])) for k in range(t) for i in range(n) for j in range(n)], "year int, target int, reference int, distance double, financial double")


def test_projection_audit(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(3, 6, 6)), rng.normal(size=(3, 6, 6))
    got = {(r["year"], r["firm"]): r for r in moments.firm_projections(cells_of(spark, x, y)).collect()}
    n = 6
    for k in range(3):
        kernel = lambda a, b: {t: sum((a[i, j] - a[i, m]) * (b[i, j] - b[i, m]) for i, j, m in ((t[0], t[1], t[2]), (t[1], t[0], t[2]), (t[2], t[0], t[1]))) / 3 for t in itertools.combinations(range(n), 3)}
        for name, h in (("numerator", kernel(x[k], y[k])), ("denominator", kernel(x[k], x[k]))):
            u = np.mean(list(h.values()))
            for f in range(n):
                own = np.mean([v for t, v in h.items() if f in t])
                assert got[k, f][name] == pytest.approx(3 * (n - 2) / (2 * (n - 1)) * (own - u))
    r = moments.projection_audit(cells_of(spark, x, y)).first()
    assert r["status"] == "defined" and r["firms"] == 6 and r["lower"] == pytest.approx(r["slope"] - 1.6448536269514722 * r["se"])
    flat = moments.projection_audit(cells_of(spark, np.ones((2, 5, 5)), y[:2, :5, :5])).first()
    assert flat["status"] == "zero_denominator" and flat["slope"] is None and flat["lower"] is None
    same = moments.projection_audit(cells_of(spark, x, 2 * x)).first()
    assert same["status"] == "degenerate_projection" and same["slope"] == pytest.approx(2) and same["lower"] is None
    assert moments.projection_audit(cells_of(spark, x[:, :3, :3], y[:, :3, :3])).first()["status"] == "too_few_firms"
    with pytest.raises(ContractError):
        moments.projection_audit(cells_of(spark, x, y).where("not (year = 1 and target = 2 and reference = 3)")).collect()


def test_shrinkage_from_sums_is_that_of_the_matrix(spark):
    x = np.random.default_rng(7).normal(size=(60, 5)) @ np.random.default_rng(8).normal(size=(5, 5))
    p = spark.createDataFrame([(k, t, float(x[t, k])) for t in range(60) for k in range(5)], "ticker int, Date int, return double")
    want, intensity = spatial.ledoit_wolf(x)
    got = spatial.shrunk_covariance(p).collect()
    assert len(got) == 25 and 0 < intensity < 1
    assert all(r["value"] == pytest.approx(want[r["ticker_i"], r["ticker_j"]]) and r["intensity"] == pytest.approx(intensity) for r in got)
    with pytest.raises(ContractError):
        spatial.shrunk_covariance(p.where("ticker > 0 or Date > 0")).collect()


def test_nested_bootstrap_with_factors(spark):
    """Loadings do not move the ratio, and under the pinned null its p is no extreme."""
    r, w1, _, _ = panel_of(spark, 0.4, 1.0, dates=80)
    n = len(w1)
    w2 = np.eye(n)[[1, 0, 3, 2, 5, 4]]
    f = np.random.default_rng(9).normal(size=(80, 1))
    loaded = (r @ (np.eye(n) - 0.4 * w1).T + f * np.linspace(-3, 3, n)) @ np.linalg.inv(np.eye(n) - 0.4 * w1).T
    q, p, draws = spatial.nested_bootstrap(r, w1, w2, 1.0, 19, 5, 3, spark, factors=f)
    other, _, _ = spatial.nested_bootstrap(loaded, w1, w2, 1.0, 19, 5, 3, spark, factors=f)
    assert q == pytest.approx(other, abs=1e-6) and q >= 0 and draws.count() == 19 and p > 0.05
    far, small, _ = spatial.nested_bootstrap(r, w1, w2, 0.0, 19, 5, 3, spark, factors=f)
    assert far > q and small == pytest.approx(0.05)
