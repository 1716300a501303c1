"""Hard negatives and mixing against plain versions."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing, negatives

VECS = "vec_id long, embedding array<double>, label long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_negatives(rows):
    own = []
    for r, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if i is not None and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        own.append((r, i, [math.floor(256 * v) for v in x], label))
    best = lambda some, k: sorted(some, key=lambda t: (-t[0], t[1] is None, t[1] or 0))[:k]
    out = []
    for r, i, x, label in own:
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=True)), j, other) for s, j, y, other in own if s != r and len(y) == len(x)]
        for p, pid, _ in best([t for t in scored if t[2] == label], 5):
            hard = [t for t in scored if t[2] != label and 50 * p <= 100 * t[0] <= 95 * p]
            out += [(i, pid, k + 1, n[1], p, n[0]) for k, n in enumerate(best(hard, 3))]
    return out


def vectors_of(kind, n=420):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        c = rng.normal(size=(12, 6))
        x = c[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, 6))
    elif kind == "ties":
        x = rng.integers(-1, 2, (n, 3)) / 4
    elif kind == "copies":  # a third of the rows are one vector
        x = rng.normal(size=(n, 4))
        x[: n // 3] = x[0]
    else:
        x = rng.normal(size=(n, 5)) * 1e5
    rows = [(int(i), [float(v) for v in y], int(rng.integers(0, 4))) for i, y in enumerate(x)]
    d = len(rows[0][1])
    rows += [(None, [0.5] * d, 1), (50, [0.25] * d, 2), (50, [0.25] * d, 3), (100, None, 1), (150, [0.5] * d, None), (200, [float("nan")] + [0.5] * (d - 1), 1), (250, [None] + [0.5] * (d - 1), 1)]
    return rows + [(300, [float("inf")] + [0.5] * (d - 1), 1), (-50, [0.5] * d, -3), (0, [], 1), (7, [], 2), (350, [0.1, 0.2], 1), (351, [0.1, 0.3], 1), (352, [0.1, 0.1], 2), (350, [0.1, 0.2], 1)]


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "wide"])
def test_negatives_match_plain(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "LIST_ROWS", 60)
    monkeypatch.setattr(negatives, "FIRST", 1)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    rows = vectors_of(kind)
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECS).withColumn("row", F.lit(1)).repartition(3)).collect()
    order = lambda t: tuple((v is None, v or 0) for v in t)
    assert sorted((tuple(r) for r in got), key=order) == sorted(plain_negatives(rows), key=order)
    assert len(got) > (20 if kind != "wide" else 0)


def test_negatives_of_an_empty_table(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1)], VECS)).count() == 0


def test_lists_are_skipped_by_their_bounds():
    rng = np.random.default_rng(1)
    c = np.array([[1000.0, 0], [0, 1000], [-1000, 0]])
    cells = negatives.Cells(c, np.array([50.0, 50, 50]), np.array([1, 1, 1]))
    x = np.concatenate([v + rng.uniform(-30, 30, (200, 2)) for v in c])
    q = rng.integers(-300, 300, (40, 2)).astype(float)
    _, least, most = cells.bounds(q)
    s = (q @ x.T).reshape(40, 3, 200)
    assert (s.max(axis=2) <= most).all() and (s.min(axis=2) >= least).all()
    at = np.arange(40)
    kth = np.sort(q @ x.T, axis=1)[:, -5]
    seen = cells.visits(q, at, kth.astype(np.int64), np.full(40, negatives.MOST), 0, 3)
    assert seen.any(axis=1).all() and not seen.all()
    for i in range(40):  # what is skipped holds none of the five best
        assert all((s[i, k] < kth[i]).all() for k in range(3) if not seen[i, k])


def test_large_products_are_exact_or_refused():
    a = np.array([[1 << 30, 3]], np.int64)
    assert negatives.products(a, a).tolist() == [[(1 << 60) + 9]]
    with pytest.raises(ArithmeticError):
        negatives.products(a << 4, a << 4)


def plain_targets(sizes):
    """By sharing out again what is above the most, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not above:
            return target | {s: weight[s] * level for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing_meets_the_targets(spark):
    rng = np.random.default_rng(5)
    sources = ["a", "b", "B", "é", "", None, "tiny", "none"]
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 90))), "en", sources[min(int(rng.exponential(1.2)), 5)], 1) for i in range(600)]
    rows += [(600, "long " * 20_000, "en", "a", 1), (601, None, None, None, None), (602, "", "en", "none", 0), (None, "x y", None, "b", 1), (None, "x y", None, "b", 1), (603, " \t\n a\x00b ", "en", "tiny", 2), (604, "copy " * 30, "en", "é", 3)]
    rows += [(605, "same row", "en", "b", 4)] * 200
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).withColumn("before", F.lit("x"))
    got = mixing.mix(docs.repartition(4)).collect()
    again = mixing.mix(docs.repartition(9)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size_of = {i: len(t.replace("\t", " ").replace("\n", " ").split()) if t else 0 for i, t, *_ in rows}
    source_of = {i: s for i, _, _, s, _ in rows}
    totals = collections.Counter()
    for i, t, _, s, _ in rows:
        totals[s] += size_of[i]
    want = plain_targets(totals)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size_of[r.doc_id] and r.source_size == totals[source_of[r.doc_id]] and r.target == pytest.approx(want[source_of[r.doc_id]])
        assert r.target / max(r.source_size, 1) // 1 * r["size"] <= r.taken <= 2 * r["size"]
        taken[source_of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_mixing_of_empty_tables(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    (row,) = mixing.mix(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()
    assert (row["size"], row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)


def test_better_documents_are_taken_more_often(spark):
    """Of two equal halves, that of four times the quality is nearly all of a half epoch, by the law of such samples."""
    rows = [(i, "good words here" if i % 2 else "12 34 56", "en", "a", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, weight=F.when(F.col("doc_id") % 2 == 1, 4.0).otherwise(1.0), share=50).toPandas()
    good = got[got.doc_id % 2 == 1].taken.sum() / got.taken.sum()
    # the halves are thinned to exp(-4 t) and exp(-t) where these add up to 1
    t = min(np.linspace(0, 3, 30001), key=lambda t: abs(math.exp(-4 * t) + math.exp(-t) - 1))
    assert good == pytest.approx((1 - math.exp(-4 * t)), abs=0.03)
