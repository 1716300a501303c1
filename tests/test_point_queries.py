"""Queries against all rows in blocks, costs by moments, and one pass for two definitions of peers."""

import os
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrata.operators import distances as D
from lodestrata.operators import studies

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(4).normal(size=(60, 5))
    x[7] = x[3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, spark.createDataFrame([(k % 3, k, x[k].tolist()) for k in range(60)], "item int, key long, v array<double>")


@pytest.mark.parametrize("size", [1 << 21, 400])
def test_query_distances_in_any_blocks(points, monkeypatch, size):
    monkeypatch.setattr(D, "BLOCK_BYTES", size)
    monkeypatch.setattr(D, "BATCH_ROWS", 100)
    x, c = points
    got = {(r["i"], r["j"]): r[2:] for r in D.query_distances(c.where("key % 3 = 0"), c).collect()}
    assert set(got) == {(i, j) for i in range(0, 60, 3) for j in range(60) if i != j}
    for (i, j), values in got.items():
        cos = min(1.0, x[i] @ x[j])
        assert values == pytest.approx((np.linalg.norm(x[i] - x[j]), 1 - cos, np.arccos(cos)), abs=3e-8)
    assert got[3, 7][0] == 0.0


def test_query_distances_do_not_copy_rows_by_blocks(points):
    plan = D.query_distances(points[1].where("key % 3 = 0"), points[1])._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_cost_totals_are_sums_of_costs(spark, points):
    _, c = points
    c = c.withColumn("v", F.transform("v", lambda x: x + 100))
    cells = {(r["item_i"], r["item_j"]): np.array(r["costs"]) for r in studies.pair_costs(c).collect()}
    got = {(r["item_i"], r["item_j"]): (r["n"], r["total"]) for r in studies.cost_totals(c).collect()}
    assert set(got) == set(cells)
    for k, costs in cells.items():
        assert got[k] == (costs.size, pytest.approx(costs.sum(), rel=1e-12))
    odd = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [1.0, None]), (3, 3, [float("nan"), 1.0]), (4, 4, [3.0, 2.0])], "item int, key int, v array<double>")
    r = {(r["item_i"], r["item_j"]): r["total"] for r in studies.cost_totals(odd).collect()}
    assert r[0, 4] == pytest.approx(4.0) and r[0, 1] is None and r[2, 2] is None and np.isnan(r[0, 3])


def test_cached_costs_hold_no_cost_of_a_pair_of_rows(spark):
    files = entry.queries()["cached_costs"](spark, SMALL).inputFiles()
    # 500 rows are 125,250 costs, a megabyte
    assert sum(os.path.getsize(urllib.parse.unquote(urllib.parse.urlparse(f).path)) for f in files) < 100_000


def test_peer_sets_take_one_pass_over_the_pairs_of_points(spark, monkeypatch):
    passes, whole = [], D.pair_means
    monkeypatch.setattr(D, "pair_means", lambda *a, **k: passes.append(1) or whole(*a, **k))
    entry.queries()["peer_overlap_sets"](spark, SMALL)
    assert len(passes) == 1


def packed(x, keys, query):
    """A block of points as a batch of one row."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([query]), pa.array([keys], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["pair", "query", "items", "vecs"])


def test_distances_of_a_pair_of_blocks_ascend(monkeypatch):
    monkeypatch.setattr(D, "BATCH_ROWS", 7)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(9, 4)), rng.normal(size=(11, 4))
    y[3], y[5, 0] = x[2], np.nan
    for held in (1 << 24, 30):
        monkeypatch.setattr(D, "PAIRS_HELD", held)
        out = [b.to_pylist() for b in D._between([packed(x, list(range(9)), True), packed(y, list(range(100, 111)), False)], decimals=3)]
        rows = [r for b in out for r in b]
        assert len(rows) == 99 and max(map(len, out)) <= 7
        for r in rows:
            a, b = x[r["i"]], y[r["j"] - 100]
            want = np.linalg.norm(a - b), 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
            assert (r["euclidean"], r["cosine"]) == pytest.approx(want, abs=6e-4, nan_ok=True)
        values = [r["euclidean"] for r in rows]
        if held > 99:
            assert values[:90] == sorted(values[:90]) and all(map(np.isnan, values[90:]))


def test_written_distances_take_few_bytes(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8))
    c = spark.createDataFrame([(0, k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(x)], "item int, key long, v array<double>")
    D.query_distances(c, c, decimals=3).write.parquet(str(tmp_path / "d"))
    # 4.6 bytes a row in the order of the points
    assert sum(p.stat().st_size for p in (tmp_path / "d").glob("*.parquet")) < 3.5 * 600 * 599


def test_table_function_meets_blocks_and_calls_no_function_for_a_pair(spark, points, monkeypatch):
    df = entry.queries()["sql_functions"](spark, SMALL)
    plan = df._jdf.queryExecution().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "zip_with" not in plan.split("FlatMapGroupsInArrow")[0]
    x, c = points
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    D.register(spark)
    # several pairs a task
    D.met_queries(c.where("key % 7 = 0"), c).repartition(2, "pair").sortWithinPartitions("pair").createOrReplaceTempView("pair_blocks")
    got = {(r["i"], r["j"]): r["euclidean"] for r in spark.sql("SELECT * FROM vector_distances(5, TABLE(pair_blocks))").collect()}
    assert set(got) == {(i, j) for i in range(0, 60, 7) for j in range(60)}
    assert all(d == pytest.approx(np.linalg.norm(x[i] - x[j]), abs=6e-6) for (i, j), d in got.items())


def test_sql_functions_of_two_vectors(spark):
    from lodestrata.functions import arrays as A

    A.register(spark)
    r = spark.sql("SELECT vector_dot(x, y), vector_norm(x), vector_euclidean(x, y), vector_cosine(x, y) FROM (SELECT array(3D, 4D) AS x, array(4D, 3D) AS y)").first()
    assert tuple(r) == pytest.approx((24, 5, 2**0.5, 1 - 24 / 25))
