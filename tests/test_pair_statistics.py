"""Ranks of values that come out differently each time they are worked out, as sums over shuffled rows do."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import pairs as P


def unsteady(spark, n):
    shaken = F.udf(lambda k: k + 1e-9 * random.random(), "double").asNondeterministic()
    return spark.range(n).select(F.col("id").cast("string").alias("item_i"), F.lit("z").alias("item_j"), shaken(F.col("id")).alias("distance"), (F.col("id") < 10).cast("int").alias("linked"), F.col("id").alias("years"))


def test_link_statistics_of_unsteady_distances(spark):
    r = P.link_statistics(unsteady(spark, 40)).first()
    assert (r["auc"], r["linked"], r["pairs"]) == (1.0, 10, 40) and r["spearman"] == pytest.approx(1.0)


def test_rank_correlations_of_unsteady_values(spark):
    r = P.rank_correlations(unsteady(spark, 40), "distance", "years").first()
    assert r["spearman"] == pytest.approx(1.0)
