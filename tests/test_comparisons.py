"""Comparisons of fields and the operators around them against NumPy on small panels."""

import datetime as dt
import math

import numpy as np
import pytest

from lodestrata.operators import comparisons as C
from lodestrata.operators import fields, resampling, simulation, spatial, studies
from lodestrata.operators.transport import balanced_assignment
from lodestrata.sources import sinks
from lodestrata.sources.contracts import ContractError

N, T = 5, 120
NAMES = [f"a{k}" for k in range(N)]
DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(T)]


def ring(seed):
    w = np.random.default_rng(seed).random((N, N))
    np.fill_diagonal(w, 0)
    return w / w.sum(axis=1, keepdims=True)


W1, W2 = ring(1), ring(2)


def table(spark, w):
    return spark.createDataFrame([(NAMES[i], NAMES[j], float(w[i, j])) for i in range(N) for j in range(N) if i != j], "target string, candidate string, weight double")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    f = rng.normal(size=T)
    e = rng.normal(size=(T, N))
    a = np.linalg.inv(np.eye(N) - 0.35 * W1 - 0.15 * W2)
    return (0.2 + f[:, None] * np.linspace(0.5, 1.5, N) + e) @ a.T, f


@pytest.fixture(scope="module")
def panel(spark, data):
    r, f = data
    return spark.createDataFrame([(NAMES[k], DAYS[t], float(r[t, k]), float(f[t])) for t in range(T) for k in range(N)], "ticker string, Date date, excess double, MKT double").persist()


def profile(r, f, theta):
    """Best rho and likelihood at a mixture, on a grid."""
    d = np.column_stack([np.ones(T), f])
    left = lambda y: y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
    w = theta * W1 + (1 - theta) * W2
    x, y, ev = left(r), left(r @ w.T), np.linalg.eigvals(w)
    best = max((-0.5 * r.size * (math.log(2 * math.pi * ((x - p * y) ** 2).sum() / r.size) + 1) + T * np.log(np.abs(1 - p * ev)).sum(), p) for p in np.linspace(-0.9, 0.9, 3601))
    return best


def test_factor_two_field(spark, panel, data):
    a, b = table(spark, W1), table(spark, W2)
    fit, beta = C.factor_two_field_qmle(panel, a, b, ["MKT"], NAMES, pinned=0.7)
    want = profile(*data, 0.7)
    assert fit["rho"] == pytest.approx(want[1], abs=1e-3) and fit["loglik"] == pytest.approx(want[0], abs=1e-3)
    free, _ = C.factor_two_field_qmle(panel, a, b, ["MKT"], NAMES)
    assert free["loglik"] >= fit["loglik"] - 1e-9 and 0 <= free["theta"] <= 1
    scores = C.factor_two_field_scores(panel, a, b, ["MKT"], NAMES, fit, beta)
    assert sum(r["score"] for r in scores.collect()) == pytest.approx(fit["loglik"], rel=1e-6)
    with pytest.raises(Exception, match="collinear"):
        C.residuals(panel.withColumnRenamed("MKT", "F").selectExpr("*", "F * 2 as G"), ["F", "G"], ["excess"])[0].collect()


def test_separation(spark, panel, data):
    r, f = data
    row = C.separation(panel, table(spark, W1), table(spark, W2), "excess", ["MKT"]).first()
    off = ~np.eye(N, dtype=bool)
    assert row["weight_correlation"] == pytest.approx(np.corrcoef(W1[off], W2[off])[0, 1])
    assert row["rms_difference"] == pytest.approx(np.sqrt(((W1 - W2)[off] ** 2).mean())) and row["support_jaccard"] == 1
    assert row["row_minimum"] == pytest.approx(min(np.corrcoef(W1[k], W2[k])[0, 1] for k in range(N)))
    s, q = r @ W1.T, r @ W2.T
    assert row["signal_correlation"] == pytest.approx(np.corrcoef(s.ravel(), q.ravel())[0, 1])
    d = np.column_stack([np.ones(T), f])
    left = lambda y: y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
    assert row["residual_correlation"] == pytest.approx(np.corrcoef(left(s).ravel(), left(q).ravel())[0, 1])
    assert C.separation(panel, table(spark, W1), table(spark, W1), "excess").first()["weak"]


def test_bridge(spark, panel):
    small = NAMES[:3]
    w = spark.createDataFrame([(i, j, 0.5) for i in small for j in small if i != j], "target string, candidate string, weight double")
    later = panel.where("ticker in ('a0', 'a1', 'a2')")
    cells = {r["cell"]: r for r in C.bridge(panel, later, w, table(spark, W1), DAYS[59], "excess").collect()}
    assert cells["small_long"]["dates"] == T and cells["small_short"]["dates"] == 60 and cells["large_short"]["assets"] == N
    assert all(r["lambda"] == pytest.approx(r["rho"] / (1 - r["rho"])) for r in cells.values())
    with pytest.raises(ContractError):
        C.bridge(panel, later.selectExpr("ticker", "Date", "excess + 1e-6 as excess"), w, table(spark, W1), DAYS[59], "excess")


def test_spatial_value(spark, data):
    r, f = data
    summary, draws = C.spatial_value(spark, r, f[:, None], {"one": W1}, 19, 5, 2)
    row = summary.first()
    alone = C.profiled(r, None, np.column_stack([np.ones(T), f]), None)
    assert row["qlr"] == pytest.approx(2 * (profile(r, f, 1.0)[0] - alone.loglik), abs=2e-3) and row["p"] == pytest.approx(1 / 20)
    assert draws.count() == 19 and draws.where("qlr < 0").count() == 0
    paired = C.spatial_value_draws(spark, (r[:60], f[:60, None]), (r[60:], f[60:, None]), {"one": W1}, 6, 5, 2).toPandas()
    wide = paired.pivot(index="draw", columns="operator", values="score")
    assert np.allclose(wide["one"] - wide["none"], paired[paired.operator == "one"].set_index("draw").gain.sort_index())
    with pytest.raises(ContractError):
        C.small(1 << 20, 1 << 20)


def test_skewness_of_degenerate_samples(spark):
    inf = float("inf")
    rows = [("flat", x) for x in [0.37] * 50] + [("few", 1.0), ("few", 2.0), ("odd", float("nan")), ("odd", inf), ("odd", 1.0), ("odd", 2.0), ("three", 0.0), ("three", 0.0), ("three", 1.0), ("three", inf)]
    rows += [("near", 0.37)] * 49 + [("near", float(np.nextafter(0.37, inf)))]
    got = {r["g"]: r["skewness"] for r in C.skewness(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    assert got.pop("three") == pytest.approx(1 / math.sqrt(2)) and set(got) == {"flat", "few", "odd", "near"} and not any(v is not None for v in got.values())


def test_merged_moments(spark):
    x = np.random.default_rng(4).normal(1e6, 1.0, 500)
    d = spark.createDataFrame([(int(k % 7), float(v)) for k, v in enumerate(x)], "g int, v double")
    row = C.merged_moments(C.accumulated(d, "v", ["g"]), []).first()
    assert row["count"] == 500 and row["mean"] == pytest.approx(x.mean()) and row["m2"] == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-6)


def test_spatial_covariance_by_hand():
    rng = np.random.default_rng(5)
    e, b, c = rng.normal(size=(80, N)), rng.normal(size=(N, 2)), np.diag([1.0, 2.0])
    inverse = np.linalg.inv(np.eye(N) - 0.3 * W1)
    d, _ = spatial.ledoit_wolf(e)
    got = spatial.spatial_covariance(0.3, W1, e, b, c)
    assert np.allclose(got, inverse @ d @ inverse.T + inverse @ b @ c @ b.T @ inverse.T)


def test_linear_solver_and_lifecycle():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(8, 8)) + 8 * np.eye(8)
    b = rng.normal(size=8)
    x, left = simulation.gmres(lambda v: a @ v, b)
    assert np.allclose(a @ x, b) and left < 1e-10 and simulation.gmres(lambda v: a @ v, np.zeros(8))[1] == 0
    e = simulation.economy(3, 4)
    z = rng.normal(size=(4, 3, 4))
    assert np.array_equal(simulation.lifecycle(e, z), simulation.path(e, z))


def test_document_transport_and_costs(spark):
    docs = {"x": [{"p": 1.0}, {"q": 1.0}], "y": [{"p": 1.0}, {"r": 1.0}]}
    v = spark.createDataFrame([(i, k, w) for i, ds in docs.items() for k, w in enumerate(ds)], "item string, doc int, weights map<string,double>")
    assert studies.document_transport(v).first()["value"] == pytest.approx(1.0)
    x = np.random.default_rng(7).normal(size=(2, 4, 3))
    c = spark.createDataFrame([(i, k, x[i, k].tolist()) for i in range(2) for k in range(4)], "item int, key int, v array<double>")
    cell = studies.pair_costs(c).where("item_i = 0 and item_j = 1").first()["costs"]
    assert np.allclose(cell, ((x[0][:, None] - x[1][None]) ** 2).sum(2))
    m = {(r["item_i"], r["item_j"]): r["coupling"] for r in fields.anchored_couplings(c).collect()}
    assert m[0, 1] == balanced_assignment(x[0], x[1], 2)[1].tolist() and [m[1, 0][k] for k in m[0, 1]] == [0, 1, 2, 3]


def test_cache_of_another_identity(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    assert sinks.cached(spark, path, "one", lambda: spark.range(3)).count() == 3
    assert sinks.cached(spark, path, "one", lambda: spark.range(9)).count() == 3
    with pytest.raises(ContractError):
        sinks.cached(spark, path, "two", lambda: spark.range(3))


def test_outer_and_inner_redraws(spark):
    archive = np.random.default_rng(8).integers(0, 5, size=(6, 3))
    t = resampling.outer_inner(spark, {4: archive}, 3, 5, 1, lambda a: float(a[:, 0].sum())).orderBy("outer").collect()
    want = [float(resampling.nested_archive(archive, 4, o, 0, 1)[:, 0].sum()) for o in range(3)]
    assert [r["estimate"] for r in t] == want and all(r["draws"] == 5 for r in t)
