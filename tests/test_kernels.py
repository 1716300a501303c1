"""Numerical kernels against definitions, closed forms and each other."""

import itertools
import math

import numpy as np
import pytest

from lodestrata.operators import fields, portfolios, quadratic, regression, simulation, spatial, transport
from lodestrata.operators.resampling import nested_archive, stationary_indices


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_assignment_is_the_best_permutation(n):
    c = np.random.default_rng(n).random((n, n))
    m = transport.assignment(c)
    assert sorted(m) == list(range(n))
    assert c[np.arange(n), m].sum() == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_transport_agrees_with_assignment_and_marginals():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=(20, 3))
    u = np.full(20, 1 / 20)
    value, plan, gap = transport.transport(transport.costs(x, y, 2), u, u)
    assert math.sqrt(value) == pytest.approx(transport.balanced_assignment(x, y, 2)[0])
    assert abs(gap) < 1e-10
    a, b = rng.dirichlet(np.ones(5)), rng.dirichlet(np.ones(8))
    value, plan, gap = transport.transport(rng.random((5, 8)), a, b)
    assert np.allclose(plan.sum(1), a) and np.allclose(plan.sum(0), b) and abs(gap) < 1e-10


def test_w2_matches_on_squared_costs():
    x, y = np.array([[0.0], [1.0]]), np.array([[1.1], [2.0]])
    assert transport.balanced_assignment(x, y, 2)[0] == pytest.approx(math.sqrt((1.1**2 + 1.0) / 2))
    c = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert transport.second_best_gap(c, *transport.matched(c)) == pytest.approx(2.0)
    with pytest.raises(ValueError):
        transport.balanced_assignment(x, y[:1])


def test_simplex_projection_and_qp():
    w = quadratic.project_simplex(np.array([0.5, 2.0, -1.0]))
    assert w == pytest.approx([0, 1, 0])
    capped = quadratic.project_capped(np.array([3.0, 1.0, 0.0]), 0.5)
    assert capped.sum() == pytest.approx(1) and capped.max() <= 0.5 + 1e-9
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 6))
    q, c = a @ a.T, rng.normal(size=6)
    x, gap = quadratic.simplex_qp(q, c)
    value = 0.5 * x @ q @ x + c @ x
    assert x.sum() == pytest.approx(1) and x.min() >= 0 and gap < 1e-8
    assert all(value <= 0.5 * z @ q @ z + c @ z + 1e-8 for z in rng.dirichlet(np.ones(6), 500))
    y = quadratic.affine_qp(q, c)
    assert y.sum() == pytest.approx(1) and np.ptp(q @ y + c) < 1e-8
    assert q @ quadratic.free_qp(q, c) == pytest.approx(-c)


def test_minimum_variance_and_certificate():
    c = np.diag([1.0, 4.0])
    w, gap = portfolios.minimum_variance(c)
    assert w == pytest.approx([0.8, 0.2], abs=1e-6)
    x = np.random.default_rng(2).normal(size=(5, 3))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    w, credit, gap = portfolios.solve_certificate(d)
    assert all(credit >= 0.5 * z @ d @ z - 1e-7 for z in np.random.default_rng(3).dirichlet(np.ones(5), 500))
    with pytest.raises(ValueError):
        portfolios.solve_certificate(-d)


def test_quantiles_of_t_and_beta():
    assert regression.t_quantile(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert regression.beta_quantile(0.5, 2, 2) == pytest.approx(0.5)
    assert regression.clopper_pearson_lower(10, 10, 0.95) == pytest.approx(0.05 ** (1 / 10))
    assert regression.clopper_pearson_lower(0, 10, 0.95) == 0


def test_pcoa_recovers_distances_and_smacof_fits():
    x = np.random.default_rng(4).normal(size=(8, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    y, values = regression.pcoa(d)
    assert np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)) == pytest.approx(d, abs=1e-8)
    assert values[0] >= values[-1]
    assert min(regression.smacof_start(d, 2, 300, [0, k])[1] for k in range(5)) < 1e-3
    assert regression.average_ranks(np.array([3.0, 1.0, 3.0])) == pytest.approx([2.5, 1, 2.5])


def test_dispersion_sees_spread():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(15, 2)), 8 * rng.normal(size=(15, 2))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    code = np.repeat([0, 1], 15)
    z = regression.dispersions(d, code)
    assert z[15:].mean() > 3 * z[:15].mean() and regression.dispersion_f(z, code) > 10


def ring(n):
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[i, (i - 1) % n] = 0.5
    return w


def test_sar_recovers_rho():
    n, t, rho = 20, 400, 0.6
    w, rng = ring(n), np.random.default_rng(6)
    r = rng.normal(size=(t, n)) @ np.linalg.inv(np.eye(n) - rho * w).T
    lag = r @ w.T
    m = {"n": n * t, "dates": t, "rr": (r * r).sum(), "rw": (r * lag).sum(), "ww": (lag * lag).sum()}
    fit = spatial.sar_qmle(m, np.linalg.eigvals(w))
    assert fit.rho == pytest.approx(rho, abs=0.03) and 0 < fit.se < 0.05
    with pytest.raises(ValueError):
        spatial.sar_gmm(w)
    assert spatial.likelihood_ratio(1.0, 1.0 + 1e-9) == 0
    with pytest.raises(ValueError):
        spatial.likelihood_ratio(1.0, 3.0)


def test_ledoit_wolf_and_scores():
    x = np.random.default_rng(7).normal(size=(60, 5))
    c, k = spatial.ledoit_wolf(x)
    assert 0 <= k <= 1 and np.linalg.eigvalsh(c).min() > 0
    assert spatial.gaussian_score(np.zeros((1, 2)), np.eye(2))[0] == pytest.approx(-math.log(2 * math.pi))


def test_network_certificate():
    c = fields.network_certificate(ring(5), 0.5)
    assert c["row_sum_error"] == pytest.approx(0) and c["resolvent_norm"] == pytest.approx(2.0) and c["dobrushin"] <= 1


def test_barycentres():
    a, b = np.array([[0.0, 0.0], [1.0, 0.0]]), np.array([[0.0, 2.0], [1.0, 2.0]])
    x, settled = fields.free_support_barycentre([a, b], np.array([0.5, 0.5]))
    assert settled and np.allclose(sorted(map(tuple, x)), [(0, 1), (1, 1)])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_second_best_gap_is_that_of_all_permutations(n):
    for seed in range(20):
        c = np.random.default_rng([n, seed]).integers(0, 9, (n, n)).astype(float)
        totals = sorted(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        m, u, v = transport.matched(c)
        assert (c - u[:, None] - v >= -1e-9).all() and np.allclose((c - u[:, None] - v)[np.arange(n), m], 0)
        assert transport.second_best_gap(c, m, u, v) == pytest.approx(totals[1] - totals[0] if n > 1 else math.inf)
    big = np.random.default_rng(n).random((128, 128))
    m, u, v = transport.matched(big)
    barred = []
    for i in range(0, 128, 16):
        other = big.copy()
        other[i, m[i]] = 1e3
        barred.append(big[np.arange(128), transport.assignment(other)].sum() - big[np.arange(128), m].sum())
    assert 0 < transport.second_best_gap(big, m, u, v) <= min(barred) + 1e-9


def test_mean_length_on_the_simplex():
    """Certified, and no worse than any of many mixtures; exact where the target is a candidate or between two."""
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(12, 3)), rng.normal(size=(5, 12, 3))
    w, value, gap = quadratic.mean_norm_simplex(x, z)
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and gap < 1e-6
    assert all(value <= np.linalg.norm(x - np.tensordot(v, z, 1), axis=1).mean() + 1e-9 for v in rng.dirichlet(np.ones(5), 3000))
    z[2] = x
    w, value, gap = quadratic.mean_norm_simplex(x, z)
    assert w[2] == pytest.approx(1, abs=1e-6) and value < 1e-6
    z = np.stack([x - 1, x + 3])
    w, value, _ = quadratic.mean_norm_simplex(x, z)
    assert w == pytest.approx([0.75, 0.25], abs=1e-6)


def test_curvature_among_directions_that_keep_the_sum():
    d = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :]).astype(float)
    assert quadratic.tangent_curvature(-d) > 0 > np.linalg.eigvalsh(-d).min()
    assert quadratic.tangent_curvature(d) < 0


def test_orthant_solver_and_paths():
    m = np.array([[2.0, 1.0], [0.0, 1.0]])
    x, bound = simulation.solve_orthant(lambda z: m @ z - np.array([1.0, -1.0]), np.ones(2), 0.5)
    assert x == pytest.approx([0.5, 0.0], abs=1e-8) and bound <= 1e-10
    e = simulation.economy(2, 3)
    z = np.random.default_rng(0).normal(size=(4, 2, 3))
    assert simulation.path(e, z) == pytest.approx(simulation.path(e, z))
    q = simulation.path(e, z)[-1]
    step = 1e-5
    moved, _ = simulation.advance(e, q, e["level"] + step)
    still, _ = simulation.advance(e, q, e["level"])
    assert (moved - still) / step == pytest.approx(simulation.linear_response(e, still, np.ones_like(q)), abs=1e-3)


def test_schedules():
    idx = stationary_indices(50, 7, np.random.default_rng(1))
    assert idx.min() >= 0 and idx.max() < 50 and (np.diff(idx) % 50 == 1).mean() > 0.6
    a = np.array([[3, 1], [0, 4]])
    assert (nested_archive(a, 1, 2, 3, 9) == nested_archive(a, 1, 2, 3, 9)).all()
    b, crit = regression.linear_gmm(np.array([1.0, 2.0]), np.array([[1.0], [2.0]]), np.eye(2))
    assert b == pytest.approx([1.0]) and crit == pytest.approx(0)
