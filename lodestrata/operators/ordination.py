"""Ordination of pair tables: principal coordinates by block iteration over the pairs, metric scaling and dispersion tests by tasks.

Pairs: (item_i, item_j, value), each unordered pair once or twice; the diagonal is zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ranks import correlation, spearman
from lodestrata.operators.pairs import neighbour_recall
from lodestrata.operators.regression import add_one_p, dispersion_f, dispersions, matrix_of, permutations_of, smacof_start
from lodestrata.shared import kept
from lodestrata.sources.contracts import ContractError


def mirrored(pairs: DataFrame, value: str = "value") -> DataFrame:
    """(item_i, item_j, value) for every ordered pair, with zeros on the diagonal."""
    half = pairs.where("item_i <> item_j").select(F.explode(F.array(F.struct("item_i", "item_j"), F.struct(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j")))).alias("p"), F.col(value).alias("value"))
    whole = half.groupBy("p.item_i", "p.item_j").agg(F.max("value").alias("value"))
    return whole.unionByName(whole.select("item_i").distinct().select("item_i", F.col("item_i").alias("item_j"), F.lit(0.0).alias("value")))


def double_centred(pairs: DataFrame, value: str = "value") -> DataFrame:
    """(item_i, item_j, b): minus half the squared distances less their row and column means, plus the grand mean."""
    sq = mirrored(pairs, value).select("item_i", "item_j", (F.col("value") * F.col("value")).alias("q"))
    rows = kept(sq.groupBy(F.col("item_i").alias("item")).agg(F.avg("q").alias("m"), F.count("q").alias("n")), "rows")
    seen = rows.agg(F.count(F.lit(1)).alias("items"), F.min("n").alias("least"), F.avg("m").alias("mean")).first()
    if seen["items"] and seen["least"] != seen["items"]:
        raise ContractError("a pair is missing")
    met = sq.join(rows.select(F.col("item").alias("item_i"), F.col("m").alias("_i")), "item_i").join(rows.select(F.col("item").alias("item_j"), F.col("m").alias("_j")), "item_j")
    return met.select("item_i", "item_j", (-0.5 * (F.col("q") - F.col("_i") - F.col("_j") + F.lit(seen["mean"]))).alias("b"))


def cross_products(batches):
    """The partial sums z'z and y'z of each batch, cell by cell."""
    for pdf in batches:
        if len(pdf):
            z, y = np.stack(pdf["z"].to_numpy()), np.stack(pdf["y"].to_numpy())
            both = np.concatenate([(z.T @ z).ravel(), (y.T @ z).ravel()])
            yield pd.DataFrame({"place": np.arange(len(both), dtype=np.int32), "s": both})


def principal_axes(pairs: DataFrame, axes: int, extra: int = 6, rounds: int = 100, tolerance: float = 1e-9, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """The spectrum's `axes` values of largest size, with their signs, in falling order, and (item, x): coordinates on the positive ones.

    A block of axes + extra vectors is multiplied by the doubly centred pairs, and made orthonormal, until its values stand still: a
    round is one join of pairs with items. The driver sees cross products of the block, never the pairs. Of each axis the largest
    entry is positive.
    """
    b = kept(double_centred(pairs), "centred")
    items = b.where("item_i = item_j").select(F.col("item_i").alias("item"))
    width, before = min(axes + extra, items.count()), None
    y = kept(items.select("item", F.array(*(F.xxhash64("item", F.lit(c), F.lit(seed)) / F.lit(float(1 << 63)) for c in range(width))).alias("y")), "block")
    combined = lambda x, t: F.array(*(sum((F.lit(float(t[a, c])) * F.col(x)[a] for a in range(t.shape[0])), F.lit(0.0)) for c in range(t.shape[1])))
    for k in range(rounds):
        sums = F.array(*(F.sum(F.col("b") * F.col("y")[c]) for c in range(width)))
        z = b.join(y.withColumnRenamed("item", "item_j"), "item_j").groupBy(F.col("item_i").alias("item")).agg(sums.alias("z"))
        both = kept(z.join(y, "item"), "block")
        row = [r["s"] for r in both.mapInPandas(cross_products, "place int, s double").groupBy("place").agg(F.sum("s").alias("s")).orderBy("place").collect()]  # twice the block's width squared
        g, h = (np.array(row[q * width * width : (q + 1) * width * width], float).reshape(width, width) for q in (0, 1))
        if k:  # the block is orthonormal from the second round on
            values, turn = np.linalg.eigh((h + h.T) / 2)
            order = np.argsort(-np.abs(values))[:axes]
            order = order[np.argsort(-values[order])]
            now = values[order]
            if before is not None and len(before) == len(now) and np.abs(now - before).max(initial=0) <= tolerance * max(np.abs(now).max(initial=0), 1e-300):
                break
            before = now
        s, v = np.linalg.eigh((g + g.T) / 2)
        keep = s > 1e-13 * max(s.max(initial=0), 1e-300)
        if not keep.any():  # all distances are zero
            return np.zeros(0), items.select("item", F.array().cast("array<double>").alias("x"))
        t = v[:, keep] / np.sqrt(s[keep])
        y, width = kept(both.select("item", combined("z", t).alias("y")), "block"), int(keep.sum())
    positive = [q for q in order if values[q] > 1e-12 * np.abs(values).max()]
    x = kept(both.select("item", combined("y", turn[:, positive] * np.sqrt(values[positive])).alias("x")), "axes")
    top = x.agg(*(F.max_by(F.col("x")[c], F.abs(F.col("x")[c])) for c in range(len(positive)))).first() if positive else []
    return now, x.select("item", F.array(*(F.col("x")[c] * float(np.sign(top[c]) or 1.0) for c in range(len(positive)))).cast("array<double>").alias("x"))


def fidelity(pairs: DataFrame, coordinates: DataFrame, k: int = 5) -> DataFrame:
    """One row: stress of a map (item, x) as it is and after its best dilation, that dilation, correlations of distances and neighbours kept.

    Correlations are null where either side's distances are all alike; k is at most the number of other items.
    """
    n = coordinates.count()
    k = max(1, min(k, n - 1))
    whole = mirrored(pairs)
    at = lambda side: coordinates.select(F.col("item").alias(f"item_{side}"), F.col("x").alias(f"x_{side}"))
    length = F.sqrt(F.aggregate(F.zip_with("x_i", "x_j", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    met = kept(whole.join(at("i"), "item_i").join(at("j"), "item_j").select("item_i", "item_j", "value", length.alias("map")), "map")
    half = met.where("item_i < item_j")
    o, p = F.col("value"), F.col("map")
    oo, op, pp = F.sum(o * o), F.sum(o * p), F.sum(p * p)
    spread = (F.max(o) > F.min(o)) & (F.max(p) > F.min(p))
    known = F.nullif(oo, F.lit(0.0))
    one = half.agg(
        F.coalesce(F.sqrt(F.sum((o - p) * (o - p)) / known), F.lit(0.0)).alias("stress"), F.coalesce(F.sqrt(F.greatest(oo - op * op / F.nullif(pp, F.lit(0.0)), F.lit(0.0)) / known), F.lit(0.0)).alias("fitted_stress"),
        F.coalesce(op / F.nullif(pp, F.lit(0.0)), F.lit(1.0)).alias("scale"), F.when(spread, correlation("value", "map")).alias("pearson"), spread.alias("_spread"),
    )
    ranks = spearman(half, "value", "map").select("spearman")
    recall = neighbour_recall(met, met.select("item_i", "item_j", F.col("map").alias("value")), k).agg(F.avg("overlap").alias("recall"), F.count_if("same_nearest").alias("same_nearest"))
    return one.crossJoin(ranks).crossJoin(recall).select("stress", "fitted_stress", "scale", "pearson", F.when(F.col("_spread"), F.col("spearman")).alias("spearman"), "recall", "same_nearest")


def metric_scaling(pairs: DataFrame, dimensions: int = 2, starts: int = 100, rounds: int = 300, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(item, x) of the start of least stress, and (start, stress, rounds) of all: each start is a task over the roster's matrix."""
    names, d = matrix_of(pairs)
    spark, kind = pairs.sparkSession, pairs.schema["item_i"].dataType.simpleString()
    held = spark.sparkContext.broadcast(d)

    def run(batches):
        for pdf in batches:
            rows = [(int(s), *smacof_start(held.value, dimensions, rounds, [seed, int(s)])) for s in pdf["start"]]
            yield pd.DataFrame([(s, stress, k, x.tolist()) for s, x, stress, k in rows], columns=["start", "stress", "rounds", "x"])

    found = kept(spark.range(starts).select(F.col("id").alias("start")).repartition(max(1, min(starts, 200)), "start").mapInPandas(run, "start long, stress double, rounds int, x array<array<double>>"), "starts")
    roster = spark.createDataFrame(list(enumerate(names)), f"place int, item {kind}")
    best = found.agg(F.min_by("x", F.struct("stress", "start")).alias("x")).select(F.posexplode("x").alias("place", "x"))
    return best.join(roster, "place").select("item", "x"), found.select("start", "stress", "rounds")


def dispersion_test(pairs: DataFrame, labels: DataFrame, draws: int = 9999, seed: int = 42) -> DataFrame:
    """One row (f, p, draws): F of distances to group centres, with permutations of the labels as tasks. labels: (item, label)."""
    names, d = matrix_of(pairs)
    given = {r[0]: r[1] for r in labels.select("item", "label").collect()}  # a row for each item of the roster
    code = np.unique([given[n] for n in names], return_inverse=True)[1]
    z = dispersions(d, code)
    observed = dispersion_f(z, code)
    p = add_one_p(permutations_of(pairs.sparkSession, draws, seed, lambda rng: dispersion_f(z, rng.permutation(code))), observed)
    return pairs.sparkSession.createDataFrame([(float(observed), float(p), draws)], "f double, p double, draws long")
