"""Portfolio weights, exposure floors and certificates. Weights: (portfolio, ticker, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ordered import sized
from lodestrata.operators.quadratic import simplex_qp
from lodestrata.sources.contracts import ContractError, none, require


def equal_weights(roster: DataFrame, name: str = "equal") -> DataFrame:
    n = roster.select("ticker").distinct().count()
    return roster.select(F.lit(name).alias("portfolio"), "ticker", F.lit(1.0 / n).alias("weight"))


def inverse_volatility_weights(volatility: DataFrame, name: str = "inverse_volatility") -> DataFrame:
    total = volatility.agg(F.sum(1 / F.col("volatility")).alias("s"))
    return volatility.join(F.broadcast(total), F.lit(True)).select(F.lit(name).alias("portfolio"), "ticker", (1 / F.col("volatility") / F.col("s")).alias("weight"))


def capital_to_budget(weights: DataFrame, volatility: DataFrame) -> DataFrame:
    """q = x sigma / sum x sigma of each portfolio."""
    w = weights.join(volatility, "ticker").withColumn("r", F.col("weight") * F.col("volatility"))
    total = w.groupBy("portfolio").agg(F.sum("r").alias("s"))
    return w.join(total, "portfolio").select("portfolio", "ticker", (F.col("r") / F.col("s")).alias("weight"))


def budget_to_capital(weights: DataFrame, volatility: DataFrame) -> DataFrame:
    """The inverse of capital_to_budget."""
    return capital_to_budget(weights, volatility.withColumn("volatility", 1 / F.col("volatility")))


def effective_number(weights: DataFrame) -> DataFrame:
    """One over the sum of squared weights."""
    return weights.groupBy("portfolio").agg((1 / F.sum(F.col("weight") * F.col("weight"))).alias("effective"))


def credit(squared: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio, credit): 0.5 q'Dq for squared distances or floors (item_i, item_j, value)."""
    return _quadratic(squared, weights).groupBy("portfolio").agg((0.5 * F.sum("term")).alias("credit"))


def _quadratic(squared: DataFrame, weights: DataFrame) -> DataFrame:
    a = weights.select("portfolio", F.col("ticker").alias("item_i"), F.col("weight").alias("q_i"))
    b = weights.select("portfolio", F.col("ticker").alias("item_j"), F.col("weight").alias("q_j"))
    return squared.join(a, "item_i").join(b, ["portfolio", "item_j"]).withColumn("term", F.col("q_i") * F.col("q_j") * F.col("value"))


def credit_decomposition(squared: DataFrame, weights: DataFrame, sectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Credit by firm (0.5 q (Dq)), by pair i < j (q_i q_j D_ij) and by sector (within plus half of cross); the sums agree."""
    terms = _quadratic(squared, weights)
    firm = terms.groupBy("portfolio", F.col("item_i").alias("ticker")).agg((0.5 * F.sum("term")).alias("credit"))
    pair = terms.where("item_i < item_j").select("portfolio", "item_i", "item_j", F.col("term").alias("credit"))
    labelled = terms.join(sectors.select(F.col("ticker").alias("item_i"), F.col("sector").alias("s_i")), "item_i").join(sectors.select(F.col("ticker").alias("item_j"), F.col("sector").alias("s_j")), "item_j")
    inside = F.col("s_i") == F.col("s_j")
    sector = labelled.groupBy("portfolio", F.col("s_i").alias("sector")).agg(F.sum(F.when(inside, 0.5 * F.col("term")).otherwise(0.0)).alias("within"), F.sum(F.when(inside, 0.0).otherwise(0.5 * F.col("term"))).alias("half_cross"))
    return firm, pair, sector.withColumn("credit", F.col("within") + F.col("half_cross"))


def exposure_floor(distances: DataFrame, scale: float, slack: float) -> DataFrame:
    """max(d / L - 2 tau, 0), squared."""
    f = F.greatest(F.col("value") / scale - 2 * slack, F.lit(0.0))
    return distances.withColumn("value", f * f)


def certificate_surface(distances: DataFrame, weights: DataFrame, scales: list[float], slacks: list[float]) -> DataFrame:
    """(portfolio, scale, slack, credit): the credit of every portfolio at each pair of grid values.

    The grid meets the pair terms after the joins with the weights, so the distances are read and joined once.
    """
    grid = distances.sparkSession.createDataFrame([(float(a), float(b)) for a in scales for b in slacks], "scale double, slack double")
    a = weights.select("portfolio", F.col("ticker").alias("item_i"), F.col("weight").alias("q_i"))
    b = weights.select("portfolio", F.col("ticker").alias("item_j"), F.col("weight").alias("q_j"))
    floor = F.greatest(F.col("value") / F.col("scale") - 2 * F.col("slack"), F.lit(0.0))
    return distances.join(a, "item_i").join(b, ["portfolio", "item_j"]).join(sized(grid), F.lit(True)).groupBy("portfolio", "scale", "slack").agg((0.5 * F.sum(F.col("q_i") * F.col("q_j") * floor * floor)).alias("credit"))


def select_cell(cells: DataFrame) -> DataFrame:
    """The passing cell (lower >= target, coverage >= target) of most credit, then smallest scale and slack."""
    return cells.where("passes_confidence and passes_coverage").orderBy(F.desc("credit"), "scale", "slack").limit(1)


def solve_certificate(squared: np.ndarray, cap: float = 1.0, tolerance: float = 1e-8) -> tuple[np.ndarray, float, float]:
    """Maximise 0.5 q'Dq on the capped simplex: (weights, credit, gap). D must be conditionally negative definite there."""
    n = len(squared)
    j = np.eye(n) - np.ones((n, n)) / n
    top = float(np.linalg.eigvalsh(j @ squared @ j).max(initial=0))
    if top > tolerance * max(1.0, np.abs(squared).max()):
        raise ValueError("not conditionally negative definite")
    # on the simplex q'Dq = 2 q'D1/n - q'Gq + const with G = -JDJ, which is positive semidefinite
    w, gap = simplex_qp(-(j @ squared @ j), -(squared.mean(axis=1) - squared.mean() / 2), cap)
    return w, float(0.5 * w @ squared @ w), gap


def minimum_variance(covariance: np.ndarray, cap: float = 1.0) -> tuple[np.ndarray, float]:
    """Long-only minimum-variance weights and the linear-oracle gap, on a scale-free problem."""
    scale = np.trace(covariance) / len(covariance) or 1.0
    return simplex_qp(covariance / scale, np.zeros(len(covariance)), cap)


#: Rounds of cutting and scaling a draw, and how far above the cap a weight may end.
CAP_ROUNDS, CAP_TOLERANCE = 100, 1e-9


def capped_draw(w: np.ndarray, cap: float) -> np.ndarray | None:
    """Weights cut at the cap and scaled to sum one, again and again, as scaling lifts some above it; None if they never settle below."""
    for _ in range(CAP_ROUNDS):
        w = np.minimum(w, cap)
        w = w / w.sum()
        if w.max() <= cap + CAP_TOLERANCE:
            return w
    return None


def reference_draws(roster: list[str], draws: int, seed: int, cap: float = 1.0, spark=None, concentration: float = 1.0) -> DataFrame:
    """(draw, ticker, weight): symmetric Dirichlet weights brought under the cap; a draw that does not get there is dropped."""
    if cap * len(roster) < 1:
        raise ContractError(f"{len(roster)} weights of at most {cap} cannot sum to one")

    def draw(batches):
        for pdf in batches:
            rows = []
            for d in pdf["draw"]:
                w = capped_draw(np.random.default_rng([seed, int(d)]).dirichlet(np.full(len(roster), concentration)), cap)
                if w is not None:
                    rows += [(int(d), t, float(x)) for t, x in zip(roster, w, strict=True)]
            yield pd.DataFrame(rows, columns=["draw", "ticker", "weight"])

    return spark.range(draws).select(F.col("id").alias("draw")).mapInPandas(draw, "draw long, ticker string, weight double")


def reference_percentile(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """(design, candidate, share): the share of reference variances at or below each candidate's."""
    return references.join(sized(candidates), F.lit(True)).groupBy("design", "candidate").agg(F.avg(F.when(F.col("variance") <= F.col("candidate_variance"), 1.0).otherwise(0.0)).alias("share"))


def turnover(weights: DataFrame) -> DataFrame:
    """(vintage, turnover): half the absolute change of weights to each vintage from the one before (vintage, ticker, weight).

    A ticker without a row in a vintage counts as zero there.
    """
    vintages = weights.select("vintage").distinct()
    tickers = weights.select("ticker").distinct()
    full = vintages.join(sized(tickers), F.lit(True)).join(weights, ["vintage", "ticker"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    w = Window.partitionBy("ticker").orderBy("vintage")
    return full.withColumn("d", F.abs(F.col("weight") - F.lag("weight").over(w))).groupBy("vintage").agg((0.5 * F.sum("d")).alias("turnover"))


def largest_changes(weights: DataFrame) -> DataFrame:
    """Rank of the weight changes to each vintage, largest first, ties by ticker."""
    w = Window.partitionBy("ticker").orderBy("vintage")
    d = weights.withColumn("change", F.col("weight") - F.lag("weight").over(w)).where("change is not null")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("vintage").orderBy(F.desc(F.abs("change")), "ticker")).cast("long"))


def exposure_envelope(dyads: DataFrame, scales: list[float], slacks: list[float]) -> DataFrame:
    """(draw, scale, slack, covered, violated, unresolved): weighted shares of dyads (draw, weight, w2, cost) by their bounds.

    lower = max(w2 / L - 2 tau, 0), upper = L w2 + 2 tau; covered if cost >= upper^2, violated if cost < lower^2. Draws of zero weight go.
    """
    grid = dyads.sparkSession.createDataFrame([(float(a), float(b)) for a in scales for b in slacks], "scale double, slack double")
    g = dyads.join(sized(grid), F.lit(True))
    lower, upper = F.greatest(F.col("w2") / F.col("scale") - 2 * F.col("slack"), F.lit(0.0)), F.col("scale") * F.col("w2") + 2 * F.col("slack")
    covered, violated = F.col("cost") - upper * upper >= 0, F.col("cost") - lower * lower < 0
    share = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0)) / F.sum("weight")
    out = g.groupBy("draw", "scale", "slack").agg(F.sum("weight").alias("total"), share(covered).alias("covered"), share(~covered & violated).alias("violated"), share(~covered & ~violated).alias("unresolved"))
    return out.where("total > 0").drop("total")


def identities(firm: DataFrame, pair: DataFrame, sector: DataFrame, tolerance: float = 1e-10) -> None:
    """Raise unless the three decompositions have equal totals."""
    total = lambda df, n: df.groupBy("portfolio").agg(F.sum("credit").alias(n))
    met = total(firm, "a").join(total(pair, "b"), "portfolio").join(total(sector, "c"), "portfolio")
    require(met, equal=none((F.abs(F.col("a") - F.col("b")) > tolerance) | (F.abs(F.col("a") - F.col("c")) > tolerance)))
