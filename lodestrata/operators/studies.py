"""Operators put together from the others: portfolio formations, vintages, directed distances, text controls and ladders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import arrays as A
from lodestrata.operators import distances as D
from lodestrata.operators.ordered import sized
from lodestrata.operators.panels import trailing_and_forward
from lodestrata.operators.portfolios import minimum_variance, solve_certificate
from lodestrata.operators.transport import balanced_assignment, costs, transport
from lodestrata.shared import kept


def formation_weights(panel: DataFrame, formations: DataFrame, lookback: int, horizon: int, cap: float = 1.0) -> DataFrame:
    """(formation, portfolio, ticker, weight): equal, inverse-volatility and minimum-variance weights from each trailing window.

    A formation's window is dates times the roster; every formation is a task of its own. Only dates before it are seen.
    """
    window = trailing_and_forward(panel, formations, panel, lookback, horizon).where("side = 'trailing'")

    def form(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="Date", columns="ticker", values="return").dropna(axis=1).sort_index(axis=1)
        names = list(wide.columns)
        c = np.atleast_2d(np.cov(wide.to_numpy(), rowvar=False))
        inverse = 1 / np.sqrt(np.maximum(np.diag(c), 1e-300))
        weights = {"equal": np.full(len(names), 1 / max(len(names), 1)), "inverse_volatility": inverse / inverse.sum(), "minimum_variance": minimum_variance(c, cap)[0]}
        rows = [(pdf["formation"].iloc[0], k, t, float(x)) for k, w in weights.items() for t, x in zip(names, w, strict=True)]
        return pd.DataFrame(rows, columns=["formation", "portfolio", "ticker", "weight"])

    return window.groupBy("formation").applyInPandas(form, "formation date, portfolio string, ticker string, weight double")


def formation_evaluation(panel: DataFrame, formations: DataFrame, weights: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """(portfolio, variance, concentration, turnover): means over formations of forward variance, sum of squares and one-way turnover."""
    from lodestrata.operators.portfolios import turnover

    forward = trailing_and_forward(panel, formations, panel, lookback, horizon).where("side = 'forward'")
    daily = forward.join(weights, ["formation", "ticker"]).groupBy("portfolio", "formation", "Date").agg(F.sum(F.col("weight") * F.col("return")).alias("r"))
    variance = daily.groupBy("portfolio", "formation").agg(F.var_samp("r").alias("v")).groupBy("portfolio").agg(F.avg("v").alias("variance"))
    concentration = weights.groupBy("portfolio", "formation").agg(F.sum(F.col("weight") * F.col("weight")).alias("c")).groupBy("portfolio").agg(F.avg("c").alias("concentration"))
    key = weights.select(F.col("formation").alias("vintage"), F.concat_ws("|", "portfolio", "ticker").alias("ticker"), "weight", "portfolio")
    moved = None
    for (name,) in sorted(weights.select("portfolio").distinct().collect()):
        one = turnover(key.where(F.col("portfolio") == name)).agg(F.lit(name).alias("portfolio"), F.avg("turnover").alias("turnover"))
        moved = one if moved is None else moved.unionByName(one)
    out = variance.join(concentration, "portfolio")
    return out.withColumn("turnover", F.lit(None).cast("double")) if moved is None else out.join(moved, "portfolio")


def placebo(distances: DataFrame, roster: list[str], seed: int) -> DataFrame:
    """The distances under a seeded permutation of their labels: (item_i, item_j, value)."""
    moved = np.random.default_rng(seed).permutation(roster).tolist()
    names = distances.sparkSession.createDataFrame(list(zip(roster, map(str, moved), strict=True)), "old string, new string")
    a, b = names.toDF("item_i", "new_i"), names.toDF("item_j", "new_j")
    return distances.join(sized(a), "item_i").join(sized(b), "item_j").select(F.col("new_i").alias("item_i"), F.col("new_j").alias("item_j"), "value")


def weight_stability(matrices: DataFrame, cap: float = 1.0) -> DataFrame:
    """(draw, ticker, weight): certificate weights solved again for each draw of squared floors (draw, item_i, item_j, value)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="item_i", columns="item_j", values="value").sort_index().sort_index(axis=1)
        w, _, _ = solve_certificate(wide.to_numpy(), cap)
        return pd.DataFrame({"draw": pdf["draw"].iloc[0], "ticker": list(wide.index), "weight": w})

    return matrices.groupBy("draw").applyInPandas(solve, "draw long, ticker string, weight double")


def vintage_distances(clouds: DataFrame, ends: list, m: int) -> DataFrame:
    """(vintage, item_i, item_j, value): squared order-2 distances of the first m rows dated up to each end. Squared once, here."""
    out = None
    for end in ends:
        d = D.wasserstein(clouds.where(F.col("date") <= F.lit(end)), 2, m)
        one = d.select(F.lit(end).alias("vintage"), "item_i", "item_j", (F.col("value") * F.col("value")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def directed_distances(laws: DataFrame, origin) -> DataFrame:
    """(year, target, reference, value): order-2 distance of each target's law in a year to each reference's law in the origin year.

    laws: (firm, year, atom, v, mass). Both sides are weighted and of any size: each pair is one transport problem in a task.
    """
    packed = laws.groupBy("firm", "year").agg(F.array_sort(F.collect_list(F.struct("atom", "v", "mass"))).alias("law"))
    now = packed.select(F.col("firm").alias("target"), "year", F.col("law").alias("x"))
    base = packed.where(F.col("year") == origin).select(F.col("firm").alias("reference"), F.col("law").alias("y"))
    pairs = now.join(base, F.col("target") != F.col("reference"))

    def law(rows) -> tuple[np.ndarray, np.ndarray]:
        mass = np.array([r["mass"] for r in rows], float)
        return np.array([list(r["v"]) for r in rows], float), mass / mass.sum()

    def solve(batches):
        for pdf in batches:
            values = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                (a, p), (b, q) = law(x), law(y)
                values.append(float(np.sqrt(max(transport(costs(a, b, 2), p, q)[0], 0.0))))
            yield pd.DataFrame({"year": pdf["year"], "target": pdf["target"], "reference": pdf["reference"], "value": values})

    firm, year = (laws.schema[c].dataType.simpleString() for c in ("firm", "year"))
    return pairs.repartition("target", "reference").mapInPandas(solve, f"year {year}, target {firm}, reference {firm}, value double")


def tfidf(documents: DataFrame) -> DataFrame:
    """(doc, weights map<string,double>): unit rows of term counts times smoothed inverse document frequencies."""
    tf = documents.select("doc", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = documents.select("doc").distinct().count()
    idf = tf.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    x = tf.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = x.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return x.join(norm, "doc").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", (F.col("x") / F.col("n")).alias("x")))).alias("weights"))


def document_transport(vectors: DataFrame) -> DataFrame:
    """(item_i, item_j, value), i < j: order-2 distance of two items' documents as sparse vectors, each document of equal weight.

    vectors: (item, doc, weights map<string,double>). Each pair is a task's unit: its two clouds meet on the terms that they hold.
    """
    packed = vectors.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("doc", F.map_keys("weights").alias("terms"), F.map_values("weights").alias("values")))).alias("docs"))
    pairs = packed.toDF("item_i", "x").join(packed.toDF("item_j", "y"), F.col("item_i") < F.col("item_j"))

    def cloud(docs, at: dict) -> np.ndarray:
        out = np.zeros((len(docs), len(at)))
        for k, d in enumerate(docs):
            out[k, [at[t] for t in d["terms"]]] = d["values"]
        return out

    def solve(batches):
        for pdf in batches:
            values = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                at = {t: k for k, t in enumerate(sorted({t for d in (*x, *y) for t in d["terms"]}))}
                c = costs(cloud(x, at), cloud(y, at), 2)
                values.append(float(np.sqrt(max(transport(c, np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y)))[0], 0.0))))
            yield pd.DataFrame({"item_i": pdf["item_i"], "item_j": pdf["item_j"], "value": values})

    kind = vectors.schema["item"].dataType.simpleString()
    return pairs.repartition("item_i", "item_j").mapInPandas(solve, f"item_i {kind}, item_j {kind}, value double")


def pair_costs(clouds: DataFrame, width: int | None = None) -> DataFrame:
    """(item_i, item_j, costs): squared costs of the rows of two clouds (item, key, v), by key, for i <= j; costs is row by row."""
    whole = D.representation(clouds, width, unit_rows=False).groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda s: s["v"]).alias("p"))
    pairs = whole.toDF("item_i", "x").join(whole.toDF("item_j", "y"), F.col("item_i") <= F.col("item_j"))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, z: s + z)
    return pairs.select("item_i", "item_j", F.transform("x", lambda a: F.transform("y", lambda b: square(a, b))).alias("costs"))


def cost_totals(clouds: DataFrame, width: int | None = None) -> DataFrame:
    """(item_i, item_j, n, total): the number and the sum of the squared costs of two clouds (item, key, v), for i <= j.

    The sum over all pairs of rows of |x - y|^2 is n_j sum |x|^2 + n_i sum |y|^2 - 2 (sum x).(sum y), whatever the origin, here the mean of
    all rows; so every row is read once and no cost is held. Where widths differ or an element is missing, it is null.
    """
    rows = D.representation(clouds, width, unit_rows=False).select("item", "v")
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    items = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.every(fine).alias("fine"))
    flat = rows.select("item", F.posexplode("v").alias("k", "x"))
    middle = flat.groupBy("k").agg(F.coalesce(F.avg(F.when(F.abs("x") < float("inf"), F.col("x"))), F.lit(0.0)).alias("middle"))
    moved = flat.join(sized(middle), "k").withColumn("x", F.col("x") - F.col("middle"))
    sums = moved.groupBy("item", "k").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    whole = sums.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("s"), F.sum("xx").alias("q"))
    # a row for each item, written down: both sides of its pairs read it
    whole = kept(items.join(whole, "item", "left").select("item", "n", F.when(F.col("fine") & (F.col("low") == F.col("high")), F.col("low")).alias("d"), F.coalesce("s", F.array().cast("array<double>")).alias("s"), F.coalesce("q", F.lit(0.0)).alias("q")), "cost-moments")
    a, b = (whole.toDF(*(f"{c}_{side}" for c in whole.columns)) for side in ("i", "j"))
    total = F.col("n_j") * F.col("q_i") + F.col("n_i") * F.col("q_j") - 2 * A.dot("s_i", "s_j")
    return a.join(b, F.col("item_i") <= F.col("item_j")).select("item_i", "item_j", (F.col("n_i") * F.col("n_j")).alias("n"), F.when(F.col("d_i") == F.col("d_j"), F.greatest(total, F.lit(0.0))).alias("total"))


def dimension_ladder(clouds: DataFrame, widths: list[int], m: int) -> DataFrame:
    """(width, pairs, same_share, switched_1, switched_2, sd): how matchings of order 1 and 2 differ at each prefix width.

    Both orders are solved on one cost matrix; switched sums are each matching's mean cost under the other's order less the best.
    Pairs are pooled by sums.
    """
    out = None
    for d in widths:
        rows = D.first_rows(D.representation(clouds, d), m)
        whole = rows.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda s: s["v"]).alias("p"))
        pairs = whole.toDF("item_i", "x").join(whole.toDF("item_j", "y"), F.col("item_i") < F.col("item_j"))

        def solve(batches):
            for pdf in batches:
                rows = []
                for x, y in zip(pdf["x"], pdf["y"], strict=True):
                    x, y = np.stack([*x]), np.stack([*y])
                    a, b = balanced_assignment(x, y, 1)[1], balanced_assignment(x, y, 2)[1]
                    c1, at = costs(x, y, 1), np.arange(len(x))
                    c2 = c1 * c1
                    rows.append((float((a == b).sum()), float(len(x)), float(c1[at, b].sum() - c1[at, a].sum()), float(c2[at, a].sum() - c2[at, b].sum()), float(c1[at, a].sum()), float(c2[at, a].sum())))
                yield pd.DataFrame(rows, columns=["same", "n", "switched_1", "switched_2", "s", "ss"])

        one = pairs.mapInPandas(solve, "same double, n double, switched_1 double, switched_2 double, s double, ss double")
        mean = F.sum("s") / F.sum("n")
        row = one.agg(F.lit(d).alias("width"), F.count(F.lit(1)).alias("pairs"), (F.sum("same") / F.sum("n")).alias("same_share"), (F.sum("switched_1") / F.sum("n")).alias("switched_1"), (F.sum("switched_2") / F.sum("n")).alias("switched_2"), F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - mean * mean, F.lit(0.0))).alias("sd"))
        out = row if out is None else out.unionByName(row)
    return out
