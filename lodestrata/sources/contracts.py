"""Checks that raise: one aggregate for each contract, compared on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table is not what its reader was promised."""


def require(df: DataFrame, **checks: Column) -> DataFrame:
    """df, if every aggregate check is true for it (an empty table passes what counts offences)."""
    row = df.agg(*(c.alias(n) for n, c in checks.items())).first()
    failed = [n for n in checks if not row[n]]
    if failed:
        raise ContractError(f"failed: {', '.join(failed)}")
    return df


def none(condition: Column) -> Column:
    """No row meets the condition."""
    return F.count_if(condition) == 0


def unique(df: DataFrame, *key: str) -> DataFrame:
    """df, if no key occurs twice and no part of a key is null."""
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ContractError(f"duplicate key {key}")
    if not df.where(" or ".join(f"`{k}` is null" for k in key)).isEmpty():
        raise ContractError(f"null in key {key}")
    return df


def unique_pair(df: DataFrame, i: str, j: str) -> DataFrame:
    """df, if each unordered pair occurs once."""
    if not df.groupBy(F.least(i, j), F.greatest(i, j)).count().where("count > 1").isEmpty():
        raise ContractError(f"pair {i}, {j} occurs twice")
    return df


def subset(df: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """df, if each of its keys is in `of`."""
    if not df.select(key).join(of.select(key), key, "left_anti").isEmpty():
        raise ContractError(f"{key} outside the roster")
    return df


def covers(df: DataFrame, roster: DataFrame, key: str) -> DataFrame:
    """df, if its keys are exactly the roster's."""
    subset(df, roster, key)
    subset(roster, df, key)
    return df


def same_rows(left: DataFrame, right: DataFrame, key: list[str]) -> None:
    """Raise unless both sides have the same rows (keys and all values), in any order."""
    names = [*key, *(c for c in left.columns if c not in key)]
    row = lambda df: df.select(*key, F.xxhash64(*names).alias("_h"))
    both = row(left).withColumnRenamed("_h", "_l").join(row(right).withColumnRenamed("_h", "_r"), key, "full")
    if not both.where(~F.col("_l").eqNullSafe(F.col("_r"))).isEmpty():
        raise ContractError("rows differ")


def square(pairs: DataFrame, i: str = "item_i", j: str = "item_j", value: str = "value", tolerance: float = 32 * 2.220446049250313e-16) -> DataFrame:
    """pairs, if they are all n^2 ordered pairs once, finite, symmetric and with a zero diagonal within tolerance."""
    unique(pairs, i, j)
    n = pairs.select(i).distinct().count()
    top = pairs.agg(F.max(F.abs(value))).first()[0] or 0.0
    bound = tolerance * max(1.0, top)
    require(pairs, complete=F.count(F.lit(1)) == n * n, finite=none(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))), diagonal=none((F.col(i) == F.col(j)) & (F.abs(value) > bound)))
    back = pairs.select(F.col(j).alias(i), F.col(i).alias(j), F.col(value).alias("_back"))
    met = pairs.join(back, [i, j], "left")
    require(met, symmetric=none(F.col("_back").isNull() | (F.abs(F.col(value) - F.col("_back")) > bound)))
    return pairs


def row_stochastic(weights: DataFrame, target: str = "target", candidate: str = "candidate", weight: str = "weight", tolerance: float = 1e-10) -> DataFrame:
    """weights, if they are nonnegative, have a zero diagonal and sum to one for every target."""
    require(weights, nonnegative=none((F.col(weight) < 0) | F.isnan(weight) | F.col(weight).isNull()), diagonal=none((F.col(target) == F.col(candidate)) & (F.col(weight) != 0)))
    require(weights.groupBy(target).agg(F.sum(weight).alias("s")), sums=none(F.abs(F.col("s") - 1) > tolerance))
    return weights
