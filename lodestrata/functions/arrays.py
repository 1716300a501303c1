"""Expressions over array<double> columns: all run in the JVM, inside code generation where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x) -> Column:
    """Elements in double precision."""
    return _c(x).cast("array<double>")


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def dot(x, y) -> Column:
    """Inner product; null where the lengths differ."""
    x, y = _c(x), _c(y)
    return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def norm(x) -> Column:
    return F.sqrt(dot(x, x))


def all_finite(x) -> Column:
    """No null, NaN or infinite element."""
    return F.forall(_c(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def each(x, number: Column, f) -> Column:
    """f(element, number) of every element. A number that a lambda captures is worked out again for each element, which for a length is
    quadratic in the width; as an array of equal numbers it is worked out once for each row.
    """
    x = _c(x)
    return F.zip_with(x, F.array_repeat(number, F.size(x)), f)


def scaled(x, factor: Column) -> Column:
    return each(x, factor, lambda v, k: v * k)


def unit(x, name: str = "row") -> Column:
    """x over its length; a zero or non-finite row is an error."""
    x = doubles(x)
    length = norm(x)
    fine = all_finite(x) & (length > 0)
    return F.when(fine, each(x, length, lambda v, n: v / n)).otherwise(F.raise_error(F.lit(f"{name}: zero or non-finite vector")).cast("array<double>"))


def prefix(x, width: int) -> Column:
    """The leading coordinates."""
    return F.slice(_c(x), 1, width)


def squared_distance(x, y) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def euclidean(x, y) -> Column:
    return F.sqrt(squared_distance(x, y))


def clipped(x, low: float, high: float) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high)), F.lit(low))


def cosine_distance(x, y) -> Column:
    return 1 - clipped(dot(x, y) / (norm(x) * norm(y)), -1.0, 1.0)


def angular(x, y) -> Column:
    """The angle between x and y, in radians."""
    return F.acos(clipped(dot(x, y) / (norm(x) * norm(y)), -1.0, 1.0))


POINT_METRICS = {"euclidean": euclidean, "cosine": cosine_distance, "angular": angular}


def chord(correlation) -> Column:
    """sqrt(2 (1 - r)) of a correlation clipped to [-1, 1]."""
    return F.sqrt(2 * (1 - clipped(correlation, -1.0, 1.0)))


def root(x) -> Column:
    """Square root of max(x, 0)."""
    return F.sqrt(F.greatest(_c(x), F.lit(0.0)))


def register(spark) -> None:
    """The vector expressions as SQL functions of the session: vector_dot, vector_norm, vector_euclidean, vector_cosine."""
    bodies = {
        "dot": "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v)",
        "euclidean": "sqrt(aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v))",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_{name}(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_norm(x ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(vector_dot(x, x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_cosine(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 - vector_dot(x, y) / (vector_norm(x) * vector_norm(y))")
