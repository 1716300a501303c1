"""Queries over seeded draws, compared with SQL by what holds for every seed: sizes, totals, ranges and pairings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestrata.operators import comparisons as C
from lodestrata.operators import distances as D
from lodestrata.operators import fields
from lodestrata.operators import portfolios as P
from lodestrata.operators import resampling as S
from lodestrata.operators import simulation
from lodestrata.operators import spatial as X
from lodestrata.operators import studies
from lodestrata.plans.clouds import R as CLOUDS
from lodestrata.plans.clouds import clouds, group_daily, rbf
from lodestrata.plans.fits import R as FITS
from lodestrata.plans.fits import equal_field, roster_of
from lodestrata.plans.inference import segment_levels
from lodestrata.plans.register import Registry, rounded
from lodestrata.sources.tables import table

R = Registry(**CLOUDS.common, **{k: FITS.common[k] for k in ("r4", "p4", "m4")})
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.query("SELECT k AS draw_id, (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM nation) AS total FROM range(200) t(k)")
def node_draw_totals(spark, sf_dir):
    """Multinomial node draws: every node has a row in every draw, and multiplicities sum to the number of nodes."""
    names = sorted(r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect())
    return S.node_counts(spark, names, 200, 5).groupBy("draw_id").agg(F.count("*").alias("nodes"), F.sum("multiplicity").alias("total"))


@R.query("SELECT k AS draw, true AS whole FROM range(50) t(k)")
def dyad_draw_weights(spark, sf_dir):
    """A draw's dyad weights sum to half of what its multiplicities' square leaves after their own squares."""
    names = sorted(r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect())
    counts = S.node_counts(spark, names, 50, 6)
    n = spark.createDataFrame([(x,) for x in names], "item string")
    pairs = n.toDF("item_i").join(n.toDF("item_j"), F.col("item_i") < F.col("item_j"))
    got = S.dyad_weights(pairs, counts).groupBy("draw_id").agg(F.sum("weight").alias("w"))
    m = F.col("multiplicity")
    want = counts.groupBy("draw_id").agg(((F.sum(m) * F.sum(m) - F.sum(m * m)) / 2).alias("v"))
    return want.join(got, "draw_id", "left").select(F.col("draw_id").alias("draw"), (F.coalesce("w", F.lit(0.0)) == F.col("v")).alias("whole"))


def calendar(spark, sf_dir) -> int:
    """The number of dates with events."""
    return table(spark, sf_dir, "events").select(F.to_date("ts")).distinct().count()


@R.query("SELECT k AS draw, (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS positions, true AS inside, true AS blocks FROM range(100) t(k)")
def stationary_paths(spark, sf_dir):
    """Stationary paths over the calendar: every position once, sources inside the sample, and blocks that go on by one between fresh starts."""
    from pyspark.sql import Window

    n = calendar(spark, sf_dir)
    t = S.index_table(spark, n, 100, 5, 9).withColumn("before", F.lag("source").over(Window.partitionBy("draw").orderBy("position")))
    on = F.sum(F.when(F.col("source") == (F.col("before") + 1) % n, 1).otherwise(0))
    return t.groupBy("draw").agg(F.count_distinct("position").alias("positions"), ((F.min("source") >= 0) & (F.max("source") < n)).alias("inside"), (on >= n // 2).alias("blocks"))


@R.query("WITH n AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS n FROM events) SELECT s AS sample, k AS draw, CASE s WHEN 'calibration' THEN n - n // 3 ELSE n // 3 END AS positions FROM (VALUES ('calibration'), ('evaluation')) v(s), range(25) t(k), n")
def paired_refit_schedules(spark, sf_dir):
    """Schedules with the same draws for two thirds of the calendar and for the rest."""
    n = calendar(spark, sf_dir)
    a, b = S.paired_schedules(spark, n - n // 3, n // 3, 25, 4, 3)
    one = lambda t, n: t.groupBy("draw").agg(F.count_distinct("position").alias("positions")).select(F.lit(n).alias("sample"), "draw", "positions")
    return one(a, "calibration").unionByName(one(b, "evaluation"))


@R.query("SELECT k AS draw, CAST(n_regionkey AS VARCHAR) AS stratum, [[sum(n_nationkey + 1.0) / (SELECT sum(n_nationkey + 1.0) FROM nation)]] AS mass FROM nation, range(30) t(k) GROUP BY 1, 2")
def stratified_redraws(spark, sf_dir):
    """Redraws within strata leave every stratum's mass as it was."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("stratum"), F.col("n_name").alias("atom"), (F.col("n_nationkey") + 1).alias("n"))
    return rounded(S.stratified_masses(n, 7, 30).groupBy("draw", "stratum").agg(F.sum("mass").alias("mass")), "mass")


def archives(spark, sf_dir) -> dict[int, np.ndarray]:
    """Counts of events by day and type for two histories: dates x atoms, of the size of a calendar and a list of types."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).cast("int").alias("h"), F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()
    days, types = sorted({r["d"] for r in e}), sorted({r["event_type"] for r in e})
    out = {h: np.zeros((len(days), len(types)), np.int64) for h in (0, 1)}
    for r in e:
        out[r["h"]][days.index(r["d"]), types.index(r["event_type"])] = r["n"]
    return out


@R.query("SELECT CAST(h AS INTEGER) AS history, CAST(o AS INTEGER) AS outer_draw, 19::BIGINT AS draws, true AS spread FROM range(2) a(h), range(16) b(o)")
def outer_inner_table(spark, sf_dir):
    """Every history's outer redraws, each with its inner ones and their spread."""
    share = lambda a: float(a[:, 0].sum() / max(a.sum(), 1))
    t = S.outer_inner(spark, archives(spark, sf_dir), 16, 19, 11, share)
    return t.select("history", F.col("outer").alias("outer_draw"), "draws", (F.col("estimate").between(0, 1) & (F.col("se") > 0)).alias("spread"))


@R.query("SELECT CAST(h AS INTEGER) AS history, CAST(r AS INTEGER) AS redraw, CAST(b AS INTEGER) AS budget, CAST(d AS INTEGER) AS date, CAST((d + 1) * b AS BIGINT) AS n FROM range(3) a(h), range(4) c(r), (VALUES (1), (5)) v(b), range(6) t(d)")
def recovery_panels(spark, sf_dir):
    """Multinomial articles of dated laws: the budget times each date's count, whatever the seed."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("atom"), (F.col("n_regionkey") + 1.0).alias("mass"))
    grid = spark.range(3).select(F.col("id").cast("int").alias("history")).crossJoin(spark.range(6).select(F.col("id").cast("int").alias("date")))
    counts = spark.range(6).select(F.col("id").cast("int").alias("date"), (F.col("id") + 1).alias("n"))
    p = S.article_panels(grid.crossJoin(n), counts, 4, [1, 5], 13)
    return p.groupBy("history", "redraw", "budget", "date").agg(F.sum("n").alias("n"))


@R.query("SELECT CAST(k AS BIGINT) AS draw, 25::BIGINT AS tickers, true AS whole, true AS capped FROM range(100) t(k)")
def reference_weights(spark, sf_dir):
    """Random long-only portfolios: weights of all tickers that sum to one, none above the cap."""
    names = sorted(r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect())
    return P.reference_draws(names, 100, 11, 0.2, spark).groupBy("draw").agg(F.count("*").alias("tickers"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("whole"), (F.max("weight") <= 0.2 + 1e-9).alias("capped"))


@R.query("SELECT CAST(k AS BIGINT) AS draw, target, count(*) AS n, true AS whole FROM field, range(20) t(k) WHERE weight > 0.1 GROUP BY 1, 2")
def random_basket_sizes(spark, sf_dir):
    """Random baskets have the sizes of the field's supports, and weights that sum to one."""
    w = fields.equal_support_field(rbf(spark, sf_dir), 0.1)
    return fields.random_baskets(w, 20, 7).where("target <> candidate").groupBy("draw", "target").agg(F.count_distinct("candidate").alias("n"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("whole"))


@R.query("SELECT c_mktsegment AS economy, CAST(t AS INTEGER) AS period, count(DISTINCT n_regionkey) * count(DISTINCT n_nationkey % 4) AS cells, true AS fine FROM customer JOIN nation ON c_nationkey = n_nationkey, range(3) b(t) GROUP BY 1, 2")
def simulated_path_cells(spark, sf_dir):
    """Every period of every economy has an intensity of each firm and activity, none negative."""
    return simulation.simulate(segment_levels(spark, sf_dir), 3).groupBy("economy", "period").agg(F.count("*").alias("cells"), (F.min("intensity") >= 0).alias("fine"))


@R.query("SELECT CAST(k AS BIGINT) AS draw, o AS operator, true AS fine FROM range(12) t(k), (VALUES ('equal'), ('none')) v(o) UNION ALL SELECT -1, 'test', true")
def spatial_value_bootstrap(spark, sf_dir):
    """Paired refits on date draws of a calibration and an evaluation sample, and a nested test whose p lies where it must."""
    p = group_daily(spark, sf_dir)
    roster = roster_of(p)
    full = p.select("Date").distinct().join(p.select("ticker").distinct(), F.lit(True)).join(p, ["Date", "ticker"], "left").fillna(0.0, ["return"])
    (r,) = C.grid_of(full, roster, ["return"])
    f = r.mean(axis=1, keepdims=True)
    w = {"equal": X.matrix(equal_field(p), roster)}
    half = len(r) // 2
    draws = C.spatial_value_draws(spark, (r[:half], f[:half]), (r[half:], f[half:]), w, 12, 4, 3)
    q, pv, _ = X.nested_bootstrap(r, w["equal"], np.eye(len(roster))[::-1], 0.5, 9, 4, 3, spark)
    test = spark.createDataFrame([(-1, "test", bool(q >= 0 and 0.1 <= pv <= 1))], "draw long, operator string, fine boolean")
    fine = F.col("score").isNotNull() & ~F.isnan("score") & ((F.col("operator") != "none") | (F.col("gain") == 0))
    return draws.select("draw", "operator", fine.alias("fine")).unionByName(test)


@R.query("WITH e AS (SELECT item_i, item_j, value FROM nrg WHERE item_i < item_j) SELECT count(*) AS pairs, [[sum(value)]] AS total, [[max(value)]] AS largest FROM e")
def placebo_labels(spark, sf_dir):
    """Distances under permuted labels keep their values."""
    e = D.energy(clouds(spark, sf_dir).withColumn("item", F.col("item").cast("string"))).where("item_i <> item_j")
    names = sorted(r[0] for r in e.select("item_i").distinct().collect())
    p = studies.placebo(e, names, 3)
    return rounded(p.agg((F.count("*") / 2).cast("long").alias("pairs"), (F.sum("value") / 2).alias("total"), F.max("value").alias("largest")), "total", "largest")


@R.query("SELECT DATE '2030-01-01' AS vintage, i AS item_i, j AS item_j, [[min(two)]] AS value FROM m4 GROUP BY 2, 3", text=("vintage",))
def vintage_archive(spark, sf_dir):
    """Squared order-2 distances of the first four rows known at a vintage."""
    import datetime as dt

    c = clouds(spark, sf_dir).withColumn("date", F.lit(dt.date(2020, 1, 1)))
    return rounded(studies.vintage_distances(c, [dt.date(2030, 1, 1)], 4), "value")


@R.query("WITH c AS (SELECT label % 4 AS firm, 1 + vec_id % 2 AS year, k, avg(CAST(embedding[k] AS DOUBLE)) AS x FROM embeddings, range(1, 1 + (SELECT max(len(embedding)) FROM embeddings)) t(k) GROUP BY 1, 2, 3), a AS (SELECT firm, year, list(x ORDER BY k) AS x FROM c GROUP BY 1, 2) SELECT CAST(a.year AS BIGINT) AS year, CAST(a.firm AS INTEGER) AS target, CAST(b.firm AS INTEGER) AS reference, [[list_distance(a.x, b.x)]] AS value FROM a JOIN a b ON b.year = 1 AND a.firm <> b.firm")
def directed_origin_distances(spark, sf_dir):
    """Laws of one atom each, a mean vector, whose distances to the origin year's laws are those of the atoms."""
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).cast("int").alias("firm"), (1 + F.col("vec_id") % 2).cast("long").alias("year"), F.posexplode("embedding").alias("k", "x"))
    mean = e.groupBy("firm", "year", "k").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("firm", "year").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("c"))
    laws = mean.select("firm", "year", F.lit(0).alias("atom"), F.transform("c", lambda s: s["x"]).alias("v"), F.lit(1.0).alias("mass"))
    return rounded(studies.directed_distances(laws, 1), "value")


@R.query("WITH w AS (SELECT n_regionkey AS item, n_nationkey % 3 AS term FROM nation), c AS (SELECT item, term, count(*) / sum(count(*)) OVER (PARTITION BY item) AS m FROM w GROUP BY 1, 2), g AS (SELECT a.item AS i, b.item AS j, t.k, coalesce((SELECT m FROM c WHERE c.item = a.item AND c.term = t.k), 0) AS p, coalesce((SELECT m FROM c WHERE c.item = b.item AND c.term = t.k), 0) AS q FROM region x, region y, range(3) t(k), (SELECT DISTINCT item FROM w) a, (SELECT DISTINCT item FROM w) b WHERE a.item = x.r_regionkey AND b.item = y.r_regionkey AND a.item < b.item) SELECT i AS item_i, j AS item_j, [[sqrt(sum(greatest(p - q, 0)) * 2)]] AS value FROM g GROUP BY 1, 2")
def document_transport(spark, sf_dir):
    """Documents of one term each: every move costs the squared distance of two unit vectors."""
    n = table(spark, sf_dir, "nation")
    v = n.select(F.col("n_regionkey").alias("item"), F.col("n_nationkey").alias("doc"), F.create_map((F.col("n_nationkey") % 3).cast("string"), F.lit(1.0)).alias("weights"))
    return rounded(studies.document_transport(v), "value")
