"""Barycentres and projections of clouds against brute force over permutations and mixtures."""

import itertools

import numpy as np
import pytest

from lodestrata.operators import distances, fields
from lodestrata.sources.contracts import ContractError

CLOUDS = "item string, key long, v array<double>"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = {c: rng.normal(size=(4, 2)) for c in "abcd"}
    x["e"] = x["a"][[2, 0, 3, 1]]
    rows = [(c, k, [float(t) for t in p]) for c, v in x.items() for k, p in enumerate(v)]
    return x, spark.createDataFrame(rows, CLOUDS).repartition(3)


def best_match(x, y, order):
    cost = lambda p: (np.linalg.norm(x - y[list(p)], axis=1) ** order).sum()
    p = sorted(itertools.permutations(range(len(x))), key=cost)
    return list(p[0]), cost(p[0]), cost(p[1]) - cost(p[0])


@pytest.mark.parametrize("order,weight", [(2, 0.5), (2, 0.2), (2, 1.0), (1, 0.5)])
def test_measure_barycentres(data, order, weight):
    x, clouds = data
    got = {(r["item_i"], r["item_j"]): r for r in fields.measure_barycentres(clouds, weight, order).collect()}
    assert len(got) == 10
    for (i, j), r in got.items():
        m, _, _ = best_match(x[i], x[j], order)
        b = np.array(r["points"])
        assert b == pytest.approx(weight * x[i] + (1 - weight) * x[j][m])
        value = sum(w * best_match(b, x[c], order)[1] / 4 for w, c in ((weight, i), (1 - weight, j)))
        assert r["objective"] == pytest.approx(value)
        # no better than the sources themselves, or other points near it
        assert all(value <= sum(w * best_match(b + d, x[c], order)[1] / 4 for w, c in ((weight, i), (1 - weight, j))) + 1e-9 for d in np.random.default_rng(0).normal(size=(20, 4, 2)) / 10)


def test_unequal_weights_at_order_one_are_refused(data):
    with pytest.raises(ContractError):
        fields.measure_barycentres(data[1], 0.3, 1)
    with pytest.raises(ContractError):
        fields.wasserstein_projections(data[1], 3)


@pytest.mark.parametrize("order", [1, 2])
def test_projections_with_certificates(data, order):
    x, clouds = data
    rows = fields.wasserstein_projections(clouds, order).collect()
    for t in x:
        own = {r["candidate"]: r for r in rows if r["target"] == t}
        z = {c: x[c][best_match(x[t], x[c], order)[0]] for c in own}
        value = lambda w: np.mean(np.linalg.norm(x[t] - sum(v * z[c] for c, v in w.items()), axis=1) ** order)
        w, r = {c: q["weight"] for c, q in own.items()}, next(iter(own.values()))
        assert sum(w.values()) == pytest.approx(1) and r["value"] == pytest.approx(value(w), abs=1e-9) and 0 <= r["gap"] < 1e-6
        assert r["assignment_gap"] == pytest.approx(min(best_match(x[t], x[c], order)[2] for c in own))
        assert all(r["value"] <= value(dict(zip(own, v, strict=True))) + 1e-7 for v in np.random.default_rng(1).dirichlet(np.ones(4), 500))
    # a and e hold the same points
    assert next(r["weight"] for r in rows if (r["target"], r["candidate"]) == ("a", "e")) == pytest.approx(1, abs=1e-5)


def test_pair_means_by_blocks(spark, data, monkeypatch):
    """Many blocks or few, the sums are those of all pairs."""
    x, clouds = data
    for size in (1 << 21, 64):
        monkeypatch.setattr(distances, "BLOCK_BYTES", size)
        got = {(r["item_i"], r["item_j"]): r["mean"] for r in distances.pair_means(clouds, "energy").collect()}
        assert len(got) == 25 and all(v == pytest.approx(np.linalg.norm(x[i][:, None] - x[j][None], axis=2).mean()) for (i, j), v in got.items())
    assert distances.pair_means(spark.createDataFrame([], CLOUDS)).count() == 0


def test_a_problem_that_is_not_convex_is_refused(spark):
    rows = [(i, j, float(i == j)) for i in "abc" for j in "abc"]
    with pytest.raises(Exception, match="not convex"):
        fields.target_projections(spark.createDataFrame(rows, "item_i string, item_j string, mean double")).collect()
