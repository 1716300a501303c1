"""Pair sums in tiles: bounded memory whatever the width, and the sums of plain differences."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import distances as D


def block(x, items):
    return pa.table({"items": pa.array([items.tolist()], pa.list_(pa.int32())), "vecs": pa.array([x.tobytes()], pa.binary())})


def plain(x, a, y, b):
    out = np.zeros((b.max() + 1, a.max() + 1))
    for p, i in zip(x, a, strict=True):
        np.add.at(out[:, i], b, np.sqrt(((y - p) ** 2).sum(axis=1)))
    return out


def test_narrow_block_holds_no_matrix_of_its_pairs():
    # 5,000 points of 16 coordinates: all their distances would be 200 MB
    x = np.random.default_rng(1).normal(size=(5000, 16))
    group = block(x, np.arange(5000) % 10)
    tracemalloc.start()
    D._block_sums("energy", 1.0, 1.0)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


@pytest.mark.parametrize("origin", [0.0, 1e4])
def test_sums_of_close_equal_and_far_points(origin):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)) * np.where(np.arange(700) % 3 == 0, 1e-4, 1.0)[:, None] + origin
    y = np.concatenate([x[:300], x[300:500] + 1e-7, rng.normal(size=(200, 8)) * 1e3 + origin])
    a, b = np.arange(700) % 7, np.arange(700) % 300
    got = D.tile_sums(x, a, 7, y, b, 300, "energy")
    np.testing.assert_allclose(got, plain(x, a, y, b), rtol=1e-9)
    assert D.tile_sums(x[:1], a[:1], 1, x[:1], a[:1], 1, "energy")[0, 0] == 0.0


def test_value_that_is_not_finite_spoils_its_own_item_alone():
    x = np.array([[1.0, 0.0], [0.0, 1.0], [np.nan, 0.0]])
    got = D.tile_sums(x, np.arange(3), 3, x, np.arange(3), 3, "energy")
    assert np.isfinite(got[:2, :2]).all() and np.isnan(got[2]).all() and np.isnan(got[:, 2]).all()


def test_blocks_grow_with_the_points():
    assert [D.blocks_of(n, 64, 10) for n in (1, 3, 2000, 51_282, 102_564, 615_384)] == [1, 3, 6, 13, 17, 19]
    # a block of many items keeps its size, as its sums have a cell for each pair of them
    assert D.blocks_of(615_384, 64, 5000) == 151


def test_pairs_of_blocks_are_dealt_evenly(spark):
    # 13 blocks, 91 pairs, 30 tasks: a hash of the pair gave one task 8 of them and two tasks none
    points = spark.range(400).select((F.col("id") % 3).cast("int").alias("item"), F.col("id").alias("key"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    met = D.met_blocks(D.packed_blocks(points, 13), 13, 30)
    rows = met.groupBy(F.spark_partition_id().alias("task"), "pair").count().collect()
    of_task = Counter(r["task"] for r in rows)
    assert sorted(r["pair"] for r in rows) == list(range(91))
    assert len(of_task) == 30 and max(of_task.values()) - min(of_task.values()) <= 1
    # the pair of a block with itself is one row, every other is two
    assert Counter(r["count"] for r in rows) == {1: 13, 2: 78}


def test_pass_over_the_pairs_has_many_even_tasks(spark):
    """As many tasks as pairs while those are few, not four for each core."""
    points = spark.range(600).select((F.col("id") % 3).cast("int").alias("item"), F.col("id").alias("key"), F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda k: F.sin(F.col("id") * k)).alias("v"))
    size = D.blocks_of(600, 4096, 3)
    seen, dealt = [], D.met_blocks
    try:
        D.met_blocks = lambda packed, blocks, tasks: seen.append((blocks, tasks)) or dealt(packed, blocks, tasks)
        means = {(r["item_i"], r["item_j"]): r["mean"] for r in D.pair_means(points).collect()}
    finally:
        D.met_blocks = dealt
    assert seen == [(size, size * (size + 1) // 2)] and len(means) == 9 and means[0, 1] == pytest.approx(means[1, 0])


def clouds_of(spark, sizes):
    rng = np.random.default_rng(len(sizes))
    x = {i: rng.normal(size=(n, 4)) for i, n in enumerate(sizes)}
    return x, spark.createDataFrame([(i, k, v.tolist()) for i, m in x.items() for k, v in enumerate(m)], "item int, key int, v array<double>")


def test_a_block_without_points_adds_nothing(spark):
    # six points in six blocks: some are empty, and a block that was copied for one of them met itself again
    x, c = clouds_of(spark, [3, 1, 2])
    got = {(r["item_i"], r["item_j"]): r["mean"] for r in D.pair_means(c).collect()}
    assert got == {(i, j): pytest.approx(np.linalg.norm(x[i][:, None] - x[j][None], axis=2).mean()) for i in x for j in x}


@pytest.mark.parametrize("size", [1 << 21, 128, 64])
def test_dispersion_meets_no_points_of_different_items(spark, monkeypatch, size):
    # an item of many blocks, several that share one, one of a single point
    x, c = clouds_of(spark, [40, 3, 1, 25])
    c = c.unionByName(spark.createDataFrame([(None, 0, [0.0] * 4)], c.schema))
    monkeypatch.setattr(D, "BLOCK_BYTES", size)
    monkeypatch.setattr(D, "pair_means", None)
    got = {r["item"]: (r["v"], r["u"]) for r in D.within_terms(c).collect()}
    mean = {i: np.linalg.norm(m[:, None] - m[None], axis=2).mean() for i, m in x.items()}
    assert got == {i: (pytest.approx(mean[i]), pytest.approx(mean[i] * len(m) / (len(m) - 1)) if len(m) > 1 else None) for i, m in x.items()}
