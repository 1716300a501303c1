"""Peer fields: row-stochastic weights (target, candidate, weight), from distances, classes, supports and projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ranks import spearman, top_k
from lodestrata.operators.pairs import row_normalized, set_overlap
from lodestrata.operators.quadratic import affine_qp, free_qp, mean_norm_simplex, simplex_qp, tangent_curvature
from lodestrata.operators.transport import balanced_assignment, costs, matched, second_best_gap
from lodestrata.shared import kept
from lodestrata.sources.contracts import ContractError

#: Targets and candidates in an array of a class at most, on average; candidates that are repeated for one target after another; tasks for each core.
FIELD_TARGETS, FIELD_CANDIDATES, FIELD_TILE, TASKS_OF_CORE = 1 << 11, 1 << 11, 1 << 8, 32


def median_off_diagonal(pairs: DataFrame, value: str = "value") -> DataFrame:
    """The median of a distance over i <> j, as one row (h)."""
    return pairs.where("item_i <> item_j").agg(F.median(value).alias("h"))


def rbf_field(squared: DataFrame, bandwidth: float | None = None) -> DataFrame:
    """exp(-D^2 / h) of squared distances (item_i, item_j, value), zero diagonal, rows normalised; h: the median off the diagonal."""
    squared = kept(squared, "squared")  # the median and the weights read it
    h = median_off_diagonal(squared) if bandwidth is None else squared.sparkSession.createDataFrame([(float(bandwidth),)], "h double")
    w = squared.where("item_i <> item_j").join(F.broadcast(h), F.lit(True))
    return row_normalized(w.select(F.col("item_i").alias("target"), F.col("item_j").alias("candidate"), F.exp(-F.col("value") / F.col("h")).alias("weight")))


def equal_support_field(weights: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One over the number of active candidates."""
    active = weights.where(F.col("weight") > tolerance)
    n = active.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return active.join(n, "target").select("target", "candidate", (1.0 / F.col("n")).alias("weight"))


def class_field(universe: DataFrame, key: str = "ticker", fine: str = "industry", coarse: str = "sector", decimals: int | None = None) -> DataFrame:
    """Equal weights, to so many decimals, on the others of the same industry, else of the same sector, else on all others.

    A target's number of others is its class's less its own rows, so no pair is counted. Targets and candidates of a class are dealt to
    arrays by a hash; each pair of arrays is a row of one small shuffle, and its task alone makes the pairs, which are shuffled nowhere.
    A tile of candidates is repeated for one target after another, so that a written table takes a small part of a byte for a pair.
    """
    u = universe.select(F.col(key).alias("t"), F.col(fine).alias("f"), F.col(coarse).alias("c"))
    nf = u.groupBy("f").agg(F.count(F.lit(1)).alias("nf"))
    nc = u.groupBy("c").agg(F.count(F.lit(1)).alias("nc"))
    # a missing class has no peers
    sized = u.join(nf, "f", "left").join(nc, "c", "left").withColumn("group", F.when(F.coalesce("nf", F.lit(0)) > 1, F.concat(F.lit("f"), F.col("f"))).when(F.coalesce("nc", F.lit(0)) > 1, F.concat(F.lit("c"), F.col("c"))).otherwise("all"))
    members = u.where("t is not null").select("t", F.explode(F.filter(F.array(F.concat(F.lit("f"), F.col("f")), F.concat(F.lit("c"), F.col("c")), F.lit("all")), lambda x: x.isNotNull())).alias("group"))
    targets = sized.where("t is not null").select("t", "group")
    # a key may have several rows: it is no candidate of any of them, and its weights are over those of all
    own = members.groupBy("group", "t").agg(F.count(F.lit(1)).alias("own"))
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    n = targets.join(sizes, "group").join(own, ["group", "t"]).groupBy("t").agg(F.sum(F.col("size") - F.col("own")).alias("n"))
    weight = 1.0 / F.col("n")
    weighted = targets.join(n.where("n > 0"), "t").select("t", "group", (weight if decimals is None else F.round(weight, decimals)).alias("weight"))
    arrays = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    dealt = kept(targets.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(sizes, "group").select("group", arrays("n", FIELD_TARGETS).alias("down"), arrays("size", FIELD_CANDIDATES).alias("across")), "classes")
    chunk = lambda df, parts, at: df.join(dealt, "group").withColumn(at, F.pmod(F.xxhash64("t"), F.col(parts)).cast("int")).groupBy("group", at, "down", "across")
    rows = chunk(weighted, "down", "i").agg(F.collect_list(F.struct(F.col("t").alias("target"), "weight")).alias("targets"))
    candidates = chunk(members, "across", "j").agg(F.collect_list("t").alias("candidates"))
    pairs = dealt.agg(F.coalesce(F.sum(F.col("down").cast("long") * F.col("across")), F.lit(0))).first()[0]
    tasks = max(1, min(pairs, TASKS_OF_CORE * universe.sparkSession.sparkContext.defaultParallelism))
    copies = lambda df, name, at, parts: df.select("group", at, name, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("j" if at == "i" else "i")).repartition(tasks, "group", "i", "j")
    met = copies(rows, "targets", "i", "across").join(copies(candidates, "candidates", "j", "down"), ["group", "i", "j"])
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.size("candidates") - 1) / FIELD_TILE).cast("int")), lambda k: F.slice("candidates", k * FIELD_TILE + 1, FIELD_TILE))
    each = met.select("targets", F.explode(tiles).alias("tile")).select(F.explode("targets").alias("r"), "tile").select("r.target", F.explode("tile").alias("candidate"), "r.weight")
    return each.where("target <> candidate")


def top_peers(weights: DataFrame, k: int, tolerance: float = 0.0) -> DataFrame:
    """The k heaviest active peers of each target (ties by name), with the mass and number of the others."""
    active = weights.where(F.col("weight") > tolerance)
    w = Window.partitionBy("target").orderBy(F.desc("weight"), "candidate")
    all_ = Window.partitionBy("target")
    ranked = active.withColumns({"rank": F.row_number().over(w).cast("long"), "_n": F.count(F.lit(1)).over(all_), "_kept": F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, k - 1 if k == 1 else Window.currentRow)), "_mass": F.sum("weight").over(all_)})
    top = ranked.where(F.col("rank") <= k)
    kept = top.groupBy("target").agg(F.sum("weight").alias("_top"))
    return top.join(kept, "target").select("target", "candidate", "weight", "rank", (F.col("_mass") - F.col("_top")).alias("other_mass"), F.greatest(F.col("_n") - k, F.lit(0)).alias("other_count"))


def top_support(weights: DataFrame, sizes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """The heaviest active candidates of each target, as many as sizes (target, size) says."""
    active = weights.where(F.col("weight") > tolerance).join(sizes, "target")
    return top_k(active, ["target"], [F.desc("weight"), "candidate"], F.col("size")).select("target", "candidate", "weight")


def peer_definitions(fields: dict[str, DataFrame]) -> DataFrame:
    """Several fields in one table, keyed by definition."""
    out = None
    for name, f in fields.items():
        one = f.select(F.lit(name).alias("definition"), "target", "candidate", "weight")
        out = one if out is None else out.unionByName(one)
    return out


def basket_overlap(baskets: DataFrame) -> DataFrame:
    """(definition_a, definition_b, target, common): how many peers two definitions share, from top baskets."""
    sets = baskets.groupBy("definition", "target").agg(F.collect_set("candidate").alias("s"))
    a, b = sets.toDF("definition_a", "target", "x"), sets.toDF("definition_b", "target", "y")
    return a.join(b, "target").where("definition_a < definition_b").select("definition_a", "definition_b", "target", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))


def weight_similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """pearson and cosine of two fields on the union of their supports, spearman on the edges they share, and mean Jaccard."""
    a, b = first.withColumnRenamed("weight", "x"), second.withColumnRenamed("weight", "y")
    # written down: a weight worked out again may end in other digits, and would then find no rank
    both = kept(a.join(b, ["target", "candidate"], "full").select("target", "candidate", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")), "both-fields")
    one = both.agg(F.corr("x", "y").alias("pearson"), (F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))
    shared = spearman(both.where("x > 0 and y > 0"), "x", "y").select("spearman")
    return one.crossJoin(shared).crossJoin(set_overlap(first, second).agg(F.avg("jaccard").alias("jaccard")))


def spatial_lag(panel: DataFrame, weights: DataFrame, value: str = "return") -> DataFrame:
    """(target, Date, lag): the weighted sum of the candidates' values on each date."""
    return panel.withColumnRenamed("ticker", "candidate").join(weights, "candidate").groupBy("target", "Date").agg(F.sum(F.col("weight") * F.col(value)).alias("lag"))


def induced_correlation(panel: DataFrame, first: DataFrame, second: DataFrame, value: str = "return") -> DataFrame:
    """Correlation of the lags that two fields induce."""
    a, b = spatial_lag(panel, first, value), spatial_lag(panel, second, value).withColumnRenamed("lag", "other")
    return a.join(b, ["target", "Date"]).agg(F.corr("lag", "other").alias("correlation"))


def random_baskets(weights: DataFrame, draws: int, seed: int, tolerance: float = 0.0) -> DataFrame:
    """(draw, target, candidate, weight): Dirichlet(1) weights on a random support of each target's size."""
    roster = sorted({r[0] for r in weights.select("target").distinct().collect()} | {r[0] for r in weights.select("candidate").distinct().collect()})
    sizes = {r["target"]: r["n"] for r in weights.where(F.col("weight") > tolerance).groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    targets = sorted(sizes)
    kind = weights.schema["target"].dataType.simpleString()

    def draw(batches):
        for pdf in batches:
            rows = []
            for d in pdf["draw"]:
                rng = np.random.default_rng([seed, int(d)])
                for t in targets:
                    others = [c for c in roster if c != t]
                    pick = rng.choice(len(others), min(sizes[t], len(others)), replace=False)
                    rows += [(int(d), t, others[i], float(w)) for i, w in zip(pick, rng.dirichlet(np.ones(len(pick))), strict=True)]
            yield pd.DataFrame(rows, columns=["draw", "target", "candidate", "weight"])

    spark = weights.sparkSession
    return spark.range(draws).select(F.col("id").alias("draw")).repartition(max(1, min(draws, 200)), "draw").mapInPandas(draw, f"draw long, target {kind}, candidate {kind}, weight double")


def support_null(first: DataFrame, second: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, jaccard): the mean overlap of random supports of first's sizes with second."""
    r = random_baskets(first, draws, seed)
    a = r.select("draw", "target", "candidate").withColumn("_a", F.lit(1))
    n_a = a.groupBy("draw", "target").agg(F.count(F.lit(1)).alias("na"))
    n_b = second.groupBy("target").agg(F.count(F.lit(1)).alias("nb"))
    common = a.join(second.select("target", "candidate"), ["target", "candidate"]).groupBy("draw", "target").agg(F.count(F.lit(1)).alias("c"))
    met = n_a.join(n_b, "target").join(common, ["draw", "target"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return met.groupBy("draw").agg(F.avg(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


#: Numbers of all clouds together that a projection may hold in each task (512 MB of doubles).
MOST_NUMBERS = 1 << 26
PROJECTION = "target string, candidate string, weight double, gap double, value double, curvature double"
#: Relative to the largest entry: a least curvature below minus this is no rounding.
CURVATURE_TOLERANCE = 1e-8


def target_projections(component: DataFrame, kind: str = "energy", feasible: str = "simplex") -> DataFrame:
    """(target, candidate, weight, gap, value, curvature): each item as a mixture of the others, from a component of pair means.

    Energy: minimise 2 sum w_j A_tj - w'Aw - A_tt; MMD: w'Kw - 2 sum w_j K_tj + K_tt. simplex, affine (sum one) or free weights.
    gap: the linear-oracle certificate of the simplex; value: the distance reached; curvature: the least one among directions that keep
    the sum of weights (of all for free ones), which must not be negative: the problem would not be convex. The component is the problem's data, n^2
    means; each target is solved in a task of its own.
    """
    # read for the roster, its size and the matrix: worked out once
    rows = kept(component.select(F.col("item_i").cast("string").alias("i"), F.col("item_j").cast("string").alias("j"), "mean"), "component")
    targets = rows.select(F.col("i").alias("target")).distinct()
    n = targets.count()
    if n * n > MOST_NUMBERS:
        raise ContractError(f"{n} items are too many for a dense problem in each task")
    matrix = rows.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "mean"))).alias("r"))
    packed = matrix.agg(F.array_sort(F.collect_list(F.struct("i", F.transform("r", lambda s: s["mean"]).alias("m")))).alias("m"))
    spark = component.sparkSession
    held = packed.first()["m"]
    names = [r["i"] for r in held]
    m = spark.sparkContext.broadcast(np.array([r["m"] for r in held]))

    def solve(batches):
        a = m.value if kind == "mmd" else -m.value
        for pdf in batches:
            out = []
            for t in pdf["target"]:
                k = names.index(t)
                rest = [x for x in range(len(names)) if x != k]
                q, c = 2 * a[np.ix_(rest, rest)], -2 * a[k, rest]
                gap = np.nan
                curvature = float(np.linalg.eigvalsh(q).min()) if feasible == "free" else tangent_curvature(q)
                if curvature < -CURVATURE_TOLERANCE * max(1.0, np.abs(q).max()):
                    raise ContractError(f"the {kind} problem of {t} is not convex: curvature {curvature}")
                if feasible == "simplex":
                    w, gap = simplex_qp(q, c)
                else:
                    w = affine_qp(q, c) if feasible == "affine" else free_qp(q, c)
                value = float(w @ q @ w / 2 + c @ w + a[k, k])
                out += [(t, names[x], float(y), float(gap), value, curvature) for x, y in zip(rest, w, strict=True)]
            yield pd.DataFrame(out, columns=["target", "candidate", "weight", "gap", "value", "curvature"])

    return targets.repartition(max(1, min(n, 200)), "target").mapInPandas(solve, PROJECTION)


def wasserstein_projections(clouds: DataFrame, order: int = 2) -> DataFrame:
    """(target, candidate, weight, gap, value, assignment_gap): weights on the others whose points, matched to the target's, best average to it.

    Couplings are fixed to the target; each pair of clouds is matched once, in a task of its own. Order 2 minimises the mean square of
    what is left at the points, order 1 its mean length. gap is the linear oracle's certificate of the weights; assignment_gap the
    least amount by which any of the target's couplings beats every other matching: 0 marks one that is not unique.
    """
    if order not in (1, 2):
        raise ContractError(f"order {order}: 1 or 2")
    size = clouds.agg(F.sum(F.size("v")).alias("s")).first()["s"] or 0
    if size > MOST_NUMBERS:
        raise ContractError(f"{size} numbers are too many to hold in a task: take fewer rows of each item (first_rows), or anchored_couplings")
    named = clouds.withColumn("item", F.col("item").cast("string"))
    whole = named.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda s: s["v"].cast("array<double>")).alias("points"))
    data = clouds.sparkSession.sparkContext.broadcast({r["item"]: np.array(r["points"]) for r in whole.toLocalIterator()})
    couplings = anchored_couplings(named, order)
    # the couplings of one target: a row of permutations for each other item
    own = couplings.groupBy(F.col("item_i").alias("target")).agg(F.array_sort(F.collect_list(F.struct("item_j", "coupling"))).alias("moved"), F.min("gap").alias("assignment_gap"))

    def solve(batches):
        clouds = data.value
        for pdf in batches:
            out = []
            for t, moved, apart in zip(pdf["target"], pdf["moved"], pdf["assignment_gap"], strict=True):
                x = clouds[t]
                z = np.stack([clouds[m["item_j"]][np.asarray(m["coupling"])] for m in moved])
                if order == 1:
                    w, value, gap = mean_norm_simplex(x, z)
                else:
                    flat = (z - x).reshape(len(z), -1)  # weights sum to one: what is left is a mixture of differences
                    q = 2 * flat @ flat.T / len(x)
                    w, gap = simplex_qp(q, np.zeros(len(z)))
                    value = float(w @ q @ w / 2)
                out += [(t, m["item_j"], float(y), float(gap), value, float(apart)) for m, y in zip(moved, w, strict=True)]
            yield pd.DataFrame(out, columns=["target", "candidate", "weight", "gap", "value", "assignment_gap"])

    return own.repartition("target").mapInPandas(solve, "target string, candidate string, weight double, gap double, value double, assignment_gap double")


def pairs_of_clouds(clouds: DataFrame) -> DataFrame:
    """(item_i, item_j, x, y): the points, by key, of every unordered pair of clouds; roster squared rows."""
    whole = clouds.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda s: s["v"].cast("array<double>")).alias("p"))
    return whole.toDF("item_i", "x").join(whole.toDF("item_j", "y"), F.col("item_i") < F.col("item_j")).repartition("item_i", "item_j")


def anchored_couplings(clouds: DataFrame, order: int = 2) -> DataFrame:
    """(item_i, item_j, coupling, gap): the matching of every ordered pair of clouds; each unordered pair is solved once and inverted.

    gap: how much dearer the best other matching is, in total cost.
    """
    kind = clouds.schema["item"].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            rows = []
            for i, j, x, y in zip(pdf["item_i"], pdf["item_j"], pdf["x"], pdf["y"], strict=True):
                x, y = np.stack([*x]), np.stack([*y])
                if len(x) != len(y):
                    raise ContractError("clouds of unequal size")
                cost = costs(x, y, order)
                m, u, v = matched(cost)
                gap = second_best_gap(cost, m, u, v)
                rows += [(i, j, m.tolist(), gap), (j, i, np.argsort(m).tolist(), gap)]
            yield pd.DataFrame(rows, columns=["item_i", "item_j", "coupling", "gap"])

    return pairs_of_clouds(clouds).mapInPandas(solve, f"item_i {kind}, item_j {kind}, coupling array<int>, gap double")


def measure_barycentres(clouds: DataFrame, first_weight: float, order: int = 2) -> DataFrame:
    """(item_i, item_j, points, objective): the barycentre of every pair of clouds of equal size, by interpolation along matched segments.

    With weights w on i and 1 - w on j a point stands at w x + (1 - w) y of its segment, which is exact at order 2. At order 1 the
    objective is linear along the segments: only equal weights make a point between them a minimiser, others are refused.
    objective: w W(b, i) + (1 - w) W(b, j), with W squared at order 2.
    """
    w = float(first_weight)
    if not 0 <= w <= 1 or order not in (1, 2):
        raise ContractError("weights lie between 0 and 1, and the order is 1 or 2")
    if order == 1 and abs(w - 0.5) > 1e-12:
        raise ContractError("at order 1 the barycentre of unequal weights is the heavier source, not a point between")
    kind = clouds.schema["item"].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            rows = []
            for i, j, x, y in zip(pdf["item_i"], pdf["item_j"], pdf["x"], pdf["y"], strict=True):
                x, y = np.stack([*x]), np.stack([*y])
                distance, m = balanced_assignment(x, y, order)
                scale = w * (1 - w) * (distance**2 if order == 2 else 2 * distance)
                rows.append((i, j, (w * x + (1 - w) * y[m]).tolist(), float(scale)))
            yield pd.DataFrame(rows, columns=["item_i", "item_j", "points", "objective"])

    return pairs_of_clouds(clouds).mapInPandas(solve, f"item_i {kind}, item_j {kind}, points array<array<double>>, objective double")


def free_support_barycentre(clouds: list[np.ndarray], weights: np.ndarray, start: np.ndarray | None = None, rounds: int = 100) -> tuple[np.ndarray, bool]:
    """Alternate exact order-2 matchings with weighted means of the matched points, until no matching changes (a local optimum)."""
    x = np.array(clouds[0] if start is None else start, float)
    before = None
    for _ in range(rounds):
        matches = [balanced_assignment(x, c, 2)[1] for c in clouds]
        if before is not None and all((a == b).all() for a, b in zip(matches, before, strict=True)):
            return x, True
        x = sum(w * c[m] for w, c, m in zip(weights, clouds, matches, strict=True))
        before = matches
    return x, False


def free_support_barycentres(clouds: DataFrame, rounds: int = 100) -> DataFrame:
    """(group, place, point, settled): the equally weighted free-support barycentre of the items of each group, in a task of its own.

    clouds: (group, item, key, v); items of a group have equally many rows, the first item's are the start.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.stack([np.asarray(v, float) for v in g.sort_values("key")["v"]]) for _, g in pdf.groupby("item", sort=True)]
        if len({len(c) for c in own}) > 1:
            raise ContractError(f"items of {pdf['group'].iloc[0]} differ in rows")
        x, settled = free_support_barycentre(own, np.full(len(own), 1 / len(own)), rounds=rounds)
        return pd.DataFrame({"group": pdf["group"].iloc[0], "place": range(len(x)), "point": list(x), "settled": settled})

    return clouds.groupBy("group").applyInPandas(solve, f"group {clouds.schema['group'].dataType.simpleString()}, place int, point array<double>, settled boolean")


def centroid_field(centroids: DataFrame) -> DataFrame:
    """Simplex least squares of each centroid (item, v) on the others: an MMD projection with the linear kernel."""
    from lodestrata.operators.distances import pair_means

    return target_projections(pair_means(centroids.withColumn("key", F.lit(0)), "linear"), "mmd")


def network_certificate(weights: np.ndarray, rho: float, tolerance: float = 1e-12, rounds: int = 10_000) -> dict[str, float]:
    """Row sums, two-step connection, Dobrushin coefficient, stationary law and bounds of the resolvent, for a small matrix."""
    n = len(weights)
    two = weights @ weights
    dobrushin = max((np.abs(weights[i] - weights[j]).sum() / 2 for i in range(n) for j in range(i)), default=0.0)
    pi = np.full(n, 1 / n)
    for _ in range(rounds):
        new = pi @ weights
        if np.abs(new - pi).sum() < tolerance:
            pi = new
            break
        pi = new
    resolvent = np.linalg.inv(np.eye(n) - rho * weights)
    return {"row_sum_error": float(np.abs(weights.sum(axis=1) - 1).max()), "two_step_min": float(two.min()), "dobrushin": float(dobrushin), "stationary_residual": float(np.abs(pi @ weights - pi).sum()), "stationary_max": float(pi.max()), "resolvent_norm": float(np.abs(resolvent).sum(axis=1).max()), "resolvent_bound": 1 / (1 - abs(rho))}


def dobrushin(weights: DataFrame) -> DataFrame:
    """Half the largest L1 distance of two rows, as one row."""
    a, b = weights.toDF("i", "candidate", "x"), weights.toDF("j", "candidate", "y")
    shared = a.join(b, "candidate").where("i < j").groupBy("i", "j").agg(F.sum(F.least("x", "y")).alias("common"))
    n = weights.select("target").distinct().count()
    pairs = n * (n - 1) // 2
    # rows sum to one: half of |x - y| is 1 less what they share; pairs that share nothing are at 1
    met = shared.agg(F.count(F.lit(1)).alias("c"), F.min("common").alias("m"))
    return met.select(F.when(F.col("c") < pairs, 1.0).otherwise(1 - F.col("m")).alias("dobrushin"))


def tune_bandwidth(scores: DataFrame) -> DataFrame:
    """The multiplier of the best score, the smaller one on an exact tie. scores: (multiplier, score)."""
    return scores.agg(F.max_by("multiplier", F.struct("score", -F.col("multiplier"))).alias("multiplier"), F.max("score").alias("score"))
