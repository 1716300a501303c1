"""Ordination of pair tables and NumPy archives against dense computations and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ordination, portfolios, regression
from lodestrata.sources import archives
from lodestrata.sources.contracts import ContractError


def pairs_of(spark, d):
    n = len(d)
    return spark.createDataFrame([(f"i{a:02d}", f"i{b:02d}", float(d[a, b])) for a in range(n) for b in range(a + 1, n)], "item_i string, item_j string, value double")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3)) * [5, 2, 0.5]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return d, pairs_of(spark, d)


@pytest.mark.parametrize("axes", [2, 5])
def test_principal_axes_are_those_of_the_matrix(cloud, axes):
    d, pairs = cloud
    values, x = ordination.principal_axes(pairs, axes)
    want, spectrum = regression.pcoa(d)[0], regression.pcoa(d)[1]
    assert values[: min(axes, 3)] == pytest.approx(spectrum[: min(axes, 3)], rel=1e-6)
    got = np.array([r["x"] for r in x.orderBy("item").collect()])
    k = got.shape[1]
    assert k == min(axes, 3) and np.abs(got) == pytest.approx(np.abs(want[:, :k]), abs=1e-3)
    if axes > 3:
        assert np.sqrt(((got[:, None] - got[None]) ** 2).sum(2)) == pytest.approx(d, abs=1e-3)


def test_distances_that_no_space_holds(spark):
    d = np.ones((6, 6)) - np.eye(6)
    d[0, 1] = d[1, 0] = 1.95
    values, x = ordination.principal_axes(pairs_of(spark, d), 6)
    spectrum = regression.pcoa(d)[1]
    assert values.min() < 0 and values.sum() == pytest.approx(spectrum.sum()) and len(x.first()["x"]) == (spectrum > 1e-9).sum()
    assert ordination.principal_axes(pairs_of(spark, np.zeros((4, 4))), 2)[0].size == 0
    with pytest.raises(ContractError):
        ordination.principal_axes(pairs_of(spark, d).where("not (item_i = 'i02' and item_j = 'i04')"), 2)


def test_map_fidelity(spark, cloud):
    d, pairs = cloud
    n = len(d)
    x = regression.pcoa(d)[0][:, :2] * 1.3
    p = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    r = ordination.fidelity(pairs, spark.createDataFrame([(f"i{k:02d}", [float(v) for v in x[k]]) for k in range(n)], "item string, x array<double>"), 4).first()
    u = np.triu_indices(n, 1)
    o, m = d[u], p[u]
    scale = o @ m / (m @ m)
    assert (r["stress"], r["fitted_stress"], r["scale"]) == pytest.approx((np.sqrt(((o - m) ** 2).sum() / (o @ o)), np.sqrt(((o - scale * m) ** 2).sum() / (o @ o)), scale))
    assert r["pearson"] == pytest.approx(np.corrcoef(o, m)[0, 1]) and r["spearman"] == pytest.approx(np.corrcoef(regression.average_ranks(o), regression.average_ranks(m))[0, 1])
    first = [set(np.argsort([d[i, j] if j != i else np.inf for j in range(n)])[:4]) for i in range(n)]
    second = [set(np.argsort([p[i, j] if j != i else np.inf for j in range(n)])[:4]) for i in range(n)]
    assert r["recall"] == pytest.approx(np.mean([len(a & b) / 4 for a, b in zip(first, second, strict=True)]))
    flat = ordination.fidelity(pairs_of(spark, np.ones((4, 4))), spark.createDataFrame([(f"i{k:02d}", [float(k), 0.0]) for k in range(4)], "item string, x array<double>")).first()
    assert flat["pearson"] is None and flat["spearman"] is None


def test_metric_scaling_takes_the_best_start(cloud):
    d, pairs = cloud
    x, starts = ordination.metric_scaling(pairs, 3, starts=6, rounds=500)
    own = {r["start"]: r["stress"] for r in starts.collect()}
    assert own == pytest.approx({k: regression.smacof_start(d, 3, 500, [0, k])[1] for k in range(6)})
    got = np.array([r["x"] for r in x.orderBy("item").collect()])
    e = np.sqrt(((got[:, None] - got[None]) ** 2).sum(2))
    assert ((d - e)[np.triu_indices(len(d), 1)] ** 2).sum() == pytest.approx(min(own.values()), abs=1e-2)


def test_dispersion_permutations(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(15, 2)), 8 * rng.normal(size=(15, 2))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    labels = spark.createDataFrame([(f"i{k:02d}", int(k > 14)) for k in range(30)], "item string, label int")
    r = ordination.dispersion_test(pairs_of(spark, d), labels, draws=199).first()
    z = regression.dispersions(d, np.repeat([0, 1], 15))
    assert r["f"] == pytest.approx(regression.dispersion_f(z, np.repeat([0, 1], 15)))
    drawn = [regression.dispersion_f(z, np.random.default_rng([42, k]).permutation(np.repeat([0, 1], 15))) for k in range(199)]
    assert r["p"] == pytest.approx((1 + sum(f >= r["f"] - 1e-9 for f in drawn)) / 200) and r["p"] < 0.05


def test_sparse_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BLOCK_ROWS", 3)
    rows = [("a", k, [c for c in range(5) if (k + c) % 3 == 0], [float(k * 10 + c) for c in range(5) if (k + c) % 3 == 0]) for k in range(8)] + [("b", 0, [], [])]
    df = spark.createDataFrame(rows, "g string, row long, columns array<int>, values array<double>")
    assert sorted(map(tuple, archives.write_npz_sparse(df, str(tmp_path / "z"), "g", 5).collect())) == [("a.npz", 8), ("b.npz", 1)]
    back = archives.npz_sparse_rows(spark, str(tmp_path / "z")).withColumn("g", F.regexp_extract("path", r"([ab])\.npz$", 1))
    assert sorted((r["g"], r["row"], r["columns"], r["values"]) for r in back.collect()) == sorted(rows)
    with np.load(tmp_path / "z/a.npz") as z:
        assert list(z["shape"]) == [8, 5] and z["indptr"][-1] == len(z["data"])
    weights = archives.sparse_weights(back.where("g = 'a'")).where("row = 0").first()["weights"]
    assert weights == {0: 0.0, 3: 3.0}
    with pytest.raises(Exception, match="not numbered"):
        archives.write_npz_sparse(df.where("row <> 2"), str(tmp_path / "y"), "g", 5).collect()


def test_dense_archives_in_blocks(spark, tmp_path, monkeypatch):
    x, y = np.arange(24.0).reshape(2, 3, 4), np.array([True, False])
    np.savez(tmp_path / "one.npz", x=x, y=y, empty=np.zeros((0, 3)))
    got = archives.npz_members(spark, str(tmp_path)).collect()
    assert {r["member"]: (r["shape"], r["values"]) for r in got} == {"x": ([2, 3, 4], list(x.ravel())), "y": ([2], [1.0, 0.0]), "empty": ([0, 3], [])}
    np.savez(tmp_path / "two.npz", names=np.array(["a"]))
    with pytest.raises(Exception, match="not numeric"):
        archives.npz_members(spark, str(tmp_path)).collect()
    np.savez(tmp_path / "three.npz", indptr=np.array([0, 2]), indices=np.array([0, 9]), data=np.ones(2), shape=np.array([1, 3]))
    with pytest.raises(Exception, match="do not fit|not a matrix"):
        archives.npz_sparse_rows(spark, str(tmp_path)).collect()


def test_draws_under_a_cap(spark):
    names = [f"n{k:02d}" for k in range(12)]
    d = portfolios.reference_draws(names, 300, 3, 0.12, spark).toPandas()
    w = d.pivot(index="draw", columns="ticker", values="weight").to_numpy()
    assert w.max() <= 0.12 + 1e-8 and np.allclose(w.sum(axis=1), 1) and 0 < len(w) <= 300
    one = np.random.default_rng([3, int(d.draw.min())]).dirichlet(np.ones(12))
    for _ in range(500):
        one = np.minimum(one, 0.12) / np.minimum(one, 0.12).sum()
    assert w[0] == pytest.approx(one, abs=1e-6)
    with pytest.raises(ContractError):
        portfolios.reference_draws(names, 3, 3, 0.05, spark)
    # at a cap that leaves hardly any room no scaling settles in time
    assert portfolios.capped_draw(np.array([0.98, 0.01, 0.01]), 1 / 3) is None or portfolios.capped_draw(np.array([0.98, 0.01, 0.01]), 1 / 3).max() <= 1 / 3 + 1e-9
