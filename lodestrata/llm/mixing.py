"""Mixing sources to target weights: budgets by filling up, documents by Efraimidis-Spirakis keys.

Sources share SHARE percent of all words by weight; none gets more than MOST times its own words, and what it leaves goes to the
others by their weights. The level L at which sum(min(weight * L, cap)) is the whole is the largest of (whole - caps before) /
weights from here on, over sources in order of cap / weight: running totals, and no loop.

A target is as many complete epochs of its source as it holds, then a part of one. For that part each document draws
-ln(u) / q, with u from a digest of its id and text and q its quality: an exponential variable of rate q, so the smallest
keys are a weighted sample without replacement. Keys are sorted within the source by ranges (operators.ordered), words are
summed up, and documents are taken while the budget lasts; the one in which it ends is taken in part, so that each source meets
its target to half a word.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, which comes last; rows that are
equal in id and text have one key and stand together; with no words at all every target is 0; an empty table gives no rows; further columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import last_only, materialize, merge, table
from lodestrata.operators.ordered import beside, running_totals

SHARE, MOST, WEIGHTS, SEED, LEAST_QUALITY = 150, 2, (3, 1, 2), "mix", 0.05


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """The share of letters among what is not white space, at least LEAST_QUALITY."""
    letters, dark = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return F.greatest(F.coalesce(F.try_divide(letters, dark), F.lit(0.0)), F.lit(LEAST_QUALITY))


def exponential(seed: str, rate: Column) -> Column:
    """-ln(u) / rate, u from 52 bits of a digest of the document."""
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    return -F.log((F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))) / rate


def targets(sources: DataFrame, whole: int, share: int = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for sources (source, source_size), of whole words in all."""
    at = running_totals(sources, [], [F.col("source").asc_nulls_last()], {"at": F.lit(1)}, materialize)
    at = at.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    filled = running_totals(at, [], [F.col("cap") / F.col("weight"), F.col("at")], {"caps": F.col("cap"), "used": F.col("weight")}, materialize)
    filled = materialize(filled, "filled")
    rest = F.lit(filled.agg(F.sum("weight")).first()[0] or 0) - F.col("used")
    level = filled.agg(F.max((F.lit(whole * share / 100) - F.col("caps")) / rest)).first()[0] or 0.0
    return filled.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level)), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, weight: Column | None = None, share: int = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; weight: the quality of a document, a positive number."""
    rate = quality(F.col("text")) if weight is None else weight
    rows = materialize(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), exponential(seed, rate).alias("key"), F.xxhash64("text").alias("mark")).withColumn("row", F.monotonically_increasing_id()), "keys")
    sources = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    placed = running_totals(rows, ["source"], [F.col("key"), F.col("doc_id"), F.col("mark"), F.col("row")], {"before": F.col("size")}, materialize)
    aims = targets(sources, whole, share, most, weights).withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source")
    placed = beside(placed.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))), aims, ["_s"])
    epochs = F.least(F.lit(most), F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))).cast("long")
    budget = F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - F.col("before")))
    return placed.withColumn("epochs", epochs).withColumn("budget", budget).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_only(spark, lambda: mix(table(spark, sf_dir, "documents")), "mixed")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    greatest(coalesce(CAST(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS DOUBLE) / nullif(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 0), 0.0), 0.05) AS q,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS u
  FROM documents
), k AS (
  SELECT *, -ln((u + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / q AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM d GROUP BY source
), f AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS caps, (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS rest
  FROM s WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(weight * (SELECT max(((SELECT sum(size) FROM d) * 1.5::DOUBLE - caps) / rest) FROM f), CAST(cap AS DOUBLE)) AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, CAST(floor(target / source_size) AS BIGINT)) END AS epochs FROM t
), p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, CAST(floor(e.target + 0.5) AS BIGINT) - e.epochs * e.source_size AS budget, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM p
"""
