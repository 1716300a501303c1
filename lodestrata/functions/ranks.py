"""Ranks, quantiles and adjustments; every order has a complete key.

Ranks of a whole table, and the adjustments built on them, go by ranges of the order (operators.ordered); windows serve groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ordered import average_ranks, running_maximum, running_totals


def average_rank(value: str, *by: str) -> Column:
    """Rank within `by`, ties at the mean of their places (1-based)."""
    w, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def percentile_rank(*order, by=()) -> Column:
    """100 (rank - 1) / (N - 1); null for a single row. The order must be free of ties."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    return F.when(n > 1, 100.0 * (F.row_number().over(w.orderBy(*order)) - 1) / (n - 1))


def top_k(df: DataFrame, by: list[str], order: list, k: int | Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank; k may be a column."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the order given (keep-last is the same with the order reversed)."""
    return top_k(df, key, order, 1, "_rank").drop("_rank")


def linear_quantiles(value: str, probabilities: list[float]) -> Column:
    """Exact quantiles with linear interpolation; NaN and null are left out."""
    return F.percentile(F.when(~F.isnan(value), F.col(value)), F.array(*map(F.lit, probabilities)))


def auc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks (Mann-Whitney); null where a class is absent."""
    r = average_ranks(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, "_r", list(by))
    pos, neg = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.sum(F.when(F.col(label) == 1, 0).otherwise(1))
    area = (F.sum(F.when(F.col(label) == 1, F.col("_r")).otherwise(0.0)) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))
    return r.groupBy(*by).agg(area.alias("auc"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of columns without nulls; null where either is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation with average ranks."""
    r = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_x", list(by)), y, "_y", list(by))
    return r.groupBy(*by).agg(correlation("_x", "_y").alias("spearman"), F.count(F.lit(1)).alias("n"))


def holm(df: DataFrame, p: str) -> DataFrame:
    """Holm-adjusted p values as column p_holm; null p stays null.

    Of equal p values the first has the largest step, so the adjusted value is one of the distinct p values' own: steps are taken,
    and their running maximum, over those.
    """
    values = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    m = values.agg(F.sum("_n")).first()[0] or 0
    placed = running_totals(values, [], [F.col("_p")], {"_before": F.col("_n")})
    stepped = running_maximum(placed, [F.col("_p")], (F.lit(m) - F.col("_before")) * F.col("_p"), "p_holm")
    return df.join(stepped.select("_p", F.least(F.lit(1.0), "p_holm").alias("p_holm")), F.col(p) == F.col("_p"), "left").drop("_p")
