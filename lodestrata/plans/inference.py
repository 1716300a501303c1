"""Queries over regressions, permutation tests, moments, rates, resampling and simulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import distances as D
from lodestrata.operators import moments as M
from lodestrata.operators import ordination as O  # noqa: E741
from lodestrata.operators import regression as G
from lodestrata.operators import resampling as S
from lodestrata.operators import simulation
from lodestrata.operators import spatial as X
from lodestrata.plans.clouds import clouds, group_daily, rbf
from lodestrata.plans.register import Registry, rounded
from lodestrata.shared import kept
from lodestrata.sources.tables import table

R = Registry(
    brand="SELECT p_brand AS b, p_size AS z, avg(p_retailprice) AS v FROM part GROUP BY 1, 2",
    dy="SELECT a.b AS item_i, c.b AS item_j, sqrt(sum((a.v - c.v) ** 2)) / 1e3 AS w2, sum(abs(a.v - c.v)) / 1e4 AS y, sum(a.v + c.v) / 1e5 AS level FROM brand a JOIN brand c USING (z) WHERE a.b < c.b GROUP BY 1, 2",
    ev="SELECT CAST(month(CAST(ts AS DATE) + INTERVAL (user_id % 60) DAY) AS INTEGER) AS year, CAST(user_id % 7 AS INTEGER) AS target, CAST((user_id // 7) % 7 AS INTEGER) AS reference, avg(value) AS distance, sum(length(props)) / 100.0 AS financial FROM events GROUP BY 1, 2, 3",
    cen="SELECT year, target, reference, financial - avg(financial) OVER (PARTITION BY year, target) AS f, distance - avg(distance) OVER (PARTITION BY year, target) AS d FROM ev WHERE target <> reference",
    rep="SELECT CAST(user_id % 9 AS INTEGER) AS history, event_type = 'purchase' AS event, event_id % 13 <> 0 AS available, CASE WHEN event_id % 17 <> 0 THEN value - 20 END AS estimate, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 0.0 ELSE value / 10 END AS se, event_type AS stratum, 5.0::DOUBLE AS oracle, CAST(sign(value - 20) AS INTEGER) AS sgn FROM events",
)
QUERIES, ORACLE_SQL = R.queries, R.sql


def dyads(spark, sf_dir) -> DataFrame:
    """(item_i, item_j, w2, y, level) of pairs of brands."""
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("b"), F.col("p_size").alias("z")).agg(F.avg("p_retailprice").alias("v"))
    met = b.toDF("item_i", "z", "x").join(b.toDF("item_j", "z", "u"), "z").where("item_i < item_j")
    d = F.col("x") - F.col("u")
    return met.groupBy("item_i", "item_j").agg((F.sqrt(F.sum(d * d)) / 1e3).alias("w2"), (F.sum(F.abs(d)) / 1e4).alias("y"), (F.sum(F.col("x") + F.col("u")) / 1e5).alias("level"))


def cells(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    year = F.month(F.date_add(F.to_date("ts"), (F.col("user_id") % 60).cast("int")))
    return e.groupBy(year.alias("year"), (F.col("user_id") % 7).cast("int").alias("target"), (F.floor(F.col("user_id") / 7) % 7).cast("int").alias("reference")).agg(F.avg("value").alias("distance"), (F.sum(F.length("props")) / 100.0).alias("financial"))


def replications(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 9).cast("int").alias("history"), (F.col("event_type") == "purchase").alias("event"), (F.col("event_id") % 13 != 0).alias("available"), F.when(F.col("event_id") % 17 != 0, F.col("value") - 20).alias("estimate"), F.when(F.col("event_id") % 19 == 0, None).when(F.col("event_id") % 23 == 0, 0.0).otherwise(F.col("value") / 10).alias("se"), F.col("event_type").alias("stratum"), F.lit(5.0).alias("oracle"), F.signum(F.col("value") - 20).cast("int").alias("sign"))


@R.query("SELECT [[regr_slope(y, w2)]] AS slope, [[regr_intercept(y, w2)]] AS intercept, [[regr_r2(y, w2)]] AS r2, CAST(regr_count(y, w2) AS BIGINT) AS n FROM dy")
def dyadic_ols_no_fe(spark, sf_dir):
    return rounded(G.ols_table(dyads(spark, sf_dir), "y", "w2"), "slope", "intercept", "r2")


@R.query("""
WITH e AS (SELECT item_i AS node, y, w2 FROM dy UNION ALL SELECT item_j, y, w2 FROM dy), t AS (SELECT regr_slope(y, w2) AS b FROM dy), n AS (SELECT DISTINCT node FROM e)
SELECT node, [[(SELECT regr_slope(y, w2) FROM dy WHERE item_i <> node AND item_j <> node)]] AS beta, [[(SELECT regr_slope(y, w2) FROM dy WHERE item_i <> node AND item_j <> node) - (SELECT b FROM t)]] AS delta, (SELECT regr_slope(y, w2) FROM dy WHERE item_i <> node AND item_j <> node) * (SELECT b FROM t) < 0 AS sign_flip FROM n
""")
def leave_one_node_out(spark, sf_dir):
    return rounded(G.leave_one_out(dyads(spark, sf_dir), "y", "w2"), "beta", "delta")


@R.query("""
WITH c AS (SELECT item_i, item_j, y - (SELECT avg(y) FROM dy) AS c FROM dy), p AS (SELECT a.c * b.c AS p, a.item_i IN (b.item_i, b.item_j) OR a.item_j IN (b.item_i, b.item_j) AS s FROM c a JOIN c b ON (a.item_i, a.item_j) < (b.item_i, b.item_j))
SELECT [[(avg(p) FILTER (s) - avg(p) FILTER (NOT s)) / (SELECT avg(c * c) FROM c)]] AS statistic FROM p
""")
def shared_endpoint_statistic(spark, sf_dir):
    return rounded(G.shared_endpoint_statistic(dyads(spark, sf_dir), "y"), "statistic")


@R.query("""
WITH l AS (SELECT DISTINCT item_i AS item, CAST(substr(item_i, 7) AS INTEGER) % 3 AS g FROM (SELECT item_i FROM dy UNION SELECT item_j FROM dy)), p AS (SELECT w2 * w2 AS sq, a.g AS ga, b.g AS gb FROM dy JOIN l a ON a.item = item_i JOIN l b ON b.item = item_j), k AS (SELECT g, count(*) AS n FROM l GROUP BY 1),
t AS (SELECT sum(sq) / (SELECT count(*) FROM l) AS sst FROM p), w AS (SELECT sum(s / n) AS w FROM (SELECT ga AS g, sum(sq) AS s FROM p WHERE ga = gb GROUP BY 1) JOIN k USING (g))
SELECT [[(sst - w) / sst]] AS r2, [[(sst - w) / 2 / (w / ((SELECT count(*) FROM l) - 3))]] AS pseudo_f, (SELECT CAST(count(*) AS BIGINT) FROM l) AS n, 3::BIGINT AS groups FROM t, w
""")
def permanova_table(spark, sf_dir):
    d = dyads(spark, sf_dir).select("item_i", "item_j", F.col("w2").alias("value"))
    return rounded(G.permanova_table(d, brand_labels(d)), "r2", "pseudo_f")


def brand_labels(d: DataFrame) -> DataFrame:
    names = d.select(F.col("item_i").alias("item")).unionByName(d.select(F.col("item_j").alias("item"))).distinct()
    return names.withColumn("label", F.substring("item", 7, 99).cast("int") % 3)


@R.query("SELECT year, [[avg(f * d)]] AS product, [[avg(d * d)]] AS square FROM cen GROUP BY 1")
def annual_moments(spark, sf_dir):
    return rounded(M.annual_moments(cells(spark, sf_dir)), "product", "square")


@R.query("SELECT [[sum(f * d) / sum(d * d)]] AS slope FROM cen")
def pooled_slope(spark, sf_dir):
    return rounded(M.pooled_slope(cells(spark, sf_dir)), "slope")


@R.query("SELECT target, [[sum(f * d) / (SELECT sum(d * d) FROM cen)]] AS contribution, [[sum(d * d) / (SELECT sum(d * d) FROM cen)]] AS share FROM cen GROUP BY 1")
def moment_contributions(spark, sf_dir):
    return rounded(M.contributions(cells(spark, sf_dir), "target"), "contribution", "share")


@R.query("SELECT y.year, [[(SELECT sum(f * d) / sum(d * d) FROM cen c WHERE c.year <> y.year)]] AS slope FROM (SELECT DISTINCT year FROM cen) y")
def leave_one_year(spark, sf_dir):
    return rounded(M.leave_one_year(cells(spark, sf_dir)), "slope")


@R.query("""
WITH x AS (SELECT k.firm, year, target, financial - avg(financial) OVER (PARTITION BY k.firm, year, target) AS f, distance - avg(distance) OVER (PARTITION BY k.firm, year, target) AS d FROM ev, (SELECT DISTINCT target AS firm FROM ev WHERE target <> reference UNION SELECT DISTINCT reference FROM ev WHERE target <> reference) k WHERE target <> reference AND target <> k.firm AND reference <> k.firm)
SELECT firm, [[sum(f * d) / nullif(sum(d * d), 0)]] AS slope FROM x GROUP BY 1
""")
def leave_one_firm(spark, sf_dir):
    return rounded(M.leave_one_firm(cells(spark, sf_dir)), "slope")


@R.query("SELECT year, [[sum(distance) / (SELECT sum(distance) FROM ev WHERE target <> reference)]] AS share, [[(SELECT sum(s * s) / (sum(s) * sum(s)) FROM (SELECT sum(distance) AS s FROM ev e WHERE e.year = o.year AND target <> reference GROUP BY target))]] AS herfindahl, [[sum(distance * financial) / sqrt(sum(distance * distance) * sum(financial * financial))]] AS alignment FROM ev o WHERE target <> reference GROUP BY year")
def corporate_summary(spark, sf_dir):
    return rounded(M.corporate_summary(cells(spark, sf_dir)), "share", "herfindahl", "alignment")


@R.query("WITH e AS (SELECT * FROM ev WHERE target <> reference) SELECT a.year, [[sum(a.financial * b.distance) / nullif((SELECT count(DISTINCT target) * (count(DISTINCT target) - 1) * (count(DISTINCT target) - 2) FROM e x WHERE x.year = a.year), 0)]] AS moment FROM e a JOIN e b ON a.year = b.year AND a.target = b.target AND a.reference <> b.reference GROUP BY 1")
def triple_moments(spark, sf_dir):
    return rounded(M.triple_moments(cells(spark, sf_dir)), "moment")


@R.query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS firm, o_orderpriority AS atom, [[sum(o_totalprice / 1e5 * (c_nationkey + 1)) / sum(c_nationkey + 1)]] AS mass FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def pooled_laws(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("firm"), F.col("o_orderpriority").alias("atom"), (F.col("o_totalprice") / 1e5).alias("mass"), (F.col("c_nationkey") + 1).alias("n"))
    return rounded(M.pooled_laws(rows), "mass")


@R.query("WITH h AS (SELECT history, avg(CASE WHEN available AND event THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM rep GROUP BY 1) SELECT [[avg(p)]] AS rate, [[sqrt(sum(p * (1 - p) / greatest(n - 1, 1))) / count(*)]] AS mcse, count(*) AS histories FROM h")
def event_rates(spark, sf_dir):
    return rounded(M.rates(replications(spark, sf_dir)), "rate", "mcse")


@R.query("""
WITH d AS (SELECT count(*) AS n, count(*) FILTER (estimate IS NULL) AS undefined, count(*) FILTER (estimate IS NOT NULL AND se IS NULL) AS unavailable, count(*) FILTER (estimate IS NOT NULL AND se = 0) AS degenerate, count(*) FILTER (estimate IS NOT NULL AND se <> 0) AS usable, count(*) FILTER (estimate IS NOT NULL AND se <> 0 AND estimate - 1.6448536269514722 * se <= 5) / count(*) AS contains, count(*) FILTER (estimate IS NOT NULL AND se <> 0 AND estimate - 1.6448536269514722 * se > 0) / count(*) AS positive FROM rep)
SELECT n, undefined, unavailable, degenerate, usable, [[contains]] AS contains, [[positive]] AS positive, [[sqrt(contains * (1 - contains) / (n - 1))]] AS contains_se, [[sqrt(positive * (1 - positive) / (n - 1))]] AS positive_se FROM d
""")
def bound_diagnostics(spark, sf_dir):
    return rounded(M.bound_diagnostics(replications(spark, sf_dir), 5.0), "contains", "positive", "contains_se", "positive_se")


@R.query("SELECT stratum, [[avg(CASE WHEN estimate IS NOT NULL AND sgn > 0 THEN 1.0 ELSE 0 END)]] AS above, [[avg(CASE WHEN estimate IS NOT NULL AND sgn < 0 THEN 1.0 ELSE 0 END)]] AS below, [[avg(CASE WHEN estimate IS NOT NULL AND sgn = 0 THEN 1.0 ELSE 0 END)]] AS unresolved, [[avg(CASE WHEN estimate IS NULL THEN 1.0 ELSE 0 END)]] AS undefined, [[avg(CASE WHEN estimate IS NOT NULL AND sgn = 1 THEN 1.0 ELSE 0 END)]] AS correct_sign, CASE WHEN count(*) = count(estimate) THEN [[sqrt(avg((estimate - oracle) ** 2))]] END AS rmse FROM rep GROUP BY 1")
def directional_performance(spark, sf_dir):
    d = replications(spark, sf_dir).withColumn("oracle_sign", F.lit(1))
    return rounded(M.directional_performance(d), "above", "below", "unresolved", "undefined", "correct_sign", "rmse")


@R.query("SELECT scenario, count(*) AS attempts, count(*) FILTER (a) AS available, [[avg(e) FILTER (a)]] AS mean, [[quantile_cont(CASE WHEN a THEN e END, 0.025)]] AS q025, [[quantile_cont(CASE WHEN a THEN e END, 0.05)]] AS q050, [[quantile_cont(CASE WHEN a THEN e END, 0.975)]] AS q975 FROM (SELECT c_mktsegment AS scenario, coalesce(c_custkey % 5 <> 0, false) AND c_custkey % 7 <> 0 AS a, c_acctbal AS e FROM customer) GROUP BY 1")
def outer_summary(spark, sf_dir):
    """Every customer is a task; those of every fifth have a result that is unavailable, those of every seventh none."""
    c = table(spark, sf_dir, "customer")
    key = [F.col("c_mktsegment").alias("scenario"), F.col("c_nationkey").alias("history"), F.col("c_custkey").alias("outer")]
    results = c.where("c_custkey % 7 <> 0").select(*key, (F.col("c_custkey") % 5 != 0).alias("available"), F.col("c_acctbal").alias("estimate"))
    return rounded(M.outer_summary(c.select(*key), results), "mean", "q025", "q050", "q975")


@R.query("SELECT event_type AS stage, count(*) AS n, [[median(value)]] AS median_s, [[max(value)]] AS max_s, round(avg(value), 3) AS mean_s FROM events GROUP BY 1")
def stage_costs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("wall_s"))
    return rounded(M.stage_costs(e), "median_s", "max_s")


@R.query("SELECT CAST(bin AS INTEGER) AS bin, [[avg(x)]] AS x, [[avg(y)]] AS y, count(*) AS n FROM (SELECT c_acctbal AS x, c_custkey AS y, ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS bin FROM customer) GROUP BY 1")
def quantile_bins(spark, sf_dir):
    return rounded(M.quantile_bins(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("y")), "x", "y", 10), "x", "y")


@R.query("""
SELECT stratum AS contrast, count(*) AS n, [[avg(estimate)]] AS mean, [[quantile_cont(estimate, 0.025)]] AS low, [[quantile_cont(estimate, 0.975)]] AS high, [[avg(CASE WHEN estimate > 0 THEN 1.0 ELSE 0 END)]] AS share_positive, [[least(1.0, 2 * least((count(*) FILTER (estimate <= 0) + 1) / (count(*) + 1), (count(*) FILTER (estimate >= 0) + 1) / (count(*) + 1)))]] AS p FROM rep WHERE estimate IS NOT NULL GROUP BY 1
""")
def contrast_summary(spark, sf_dir):
    d = replications(spark, sf_dir).select(F.col("stratum").alias("contrast"), F.col("estimate").alias("difference"))
    return rounded(G.contrast_summary(d), "mean", "low", "high", "share_positive", "p")


@R.query("SELECT p_partkey, [[-2 * ll + 2 * k]] AS aic, [[-2 * ll + 2 * k * ln(ln(d))]] AS hqc_dates, [[-2 * ll + 2 * k * ln(ln(d * a))]] AS hqc_days, [[-2 * ll + k * ln(d)]] AS bic_dates, [[-2 * ll + k * ln(d * a)]] AS bic_days FROM (SELECT p_partkey, -p_retailprice AS ll, p_size % 5 + 1 AS k, 100 + p_size AS d, 50 AS a FROM part)")
def information_criteria(spark, sf_dir):
    f = table(spark, sf_dir, "part").select("p_partkey", (-F.col("p_retailprice")).alias("loglik"), (F.col("p_size") % 5 + 1).alias("parameters"), (100 + F.col("p_size")).alias("dates"), F.lit(50).alias("assets"))
    names = ["aic", "hqc_dates", "hqc_days", "bic_dates", "bic_days"]
    return rounded(G.information_criteria(f).select("p_partkey", *names), *names)


@R.query()
def dyadic_node_effects(spark, sf_dir):
    """Slope with symmetric endpoint effects, and the ladder of specifications before it."""
    fits = G.model_ladder(dyads(spark, sf_dir), "y", (("w2",), ("w2", "level")))
    rows = [(f["model"], c, b, float(f["r2"]), int(f["n"])) for f in fits for c, b in f["beta"].items()]
    return rounded(spark.createDataFrame(rows, "model int, term string, beta double, r2 double, n long"), "beta", "r2")


@R.query()
def mantel_test(spark, sf_dir):
    c = clouds(spark, sf_dir)
    r = G.mantel(D.energy(c), D.mmd(c, "linear"), "spearman", draws=9999)
    return rounded(spark.createDataFrame([r], "statistic double, p double, draws long"), "statistic", "p")


@R.query()
def permanova_test(spark, sf_dir):
    e = D.energy_metric(D.energy(clouds(spark, sf_dir)))
    labels = e.select(F.col("item_i").alias("item")).distinct().withColumn("label", F.col("item") % 3)
    return rounded(spark.createDataFrame([G.permanova(e, labels, draws=9999)], "pseudo_f double, r2 double, p double"), "pseudo_f", "r2", "p")


@R.query()
def pcoa_spectrum(spark, sf_dir):
    values, _ = O.principal_axes(D.energy_metric(D.energy(clouds(spark, sf_dir))), 10)
    return rounded(G.inertia(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "axis int, eigenvalue double")), "eigenvalue", "cumulative")


@R.query()
def bootstrap_slope_band(spark, sf_dir):
    """Slope of y on w2 under multinomial node draws, and its quantile band."""
    d = dyads(spark, sf_dir)
    nodes = sorted(r["item"] for r in brand_labels(d).select("item").collect())
    slopes = S.bootstrap_slopes(d, S.node_counts(spark, nodes, 2000, 3), "y", "w2").withColumn("cell", F.lit("w2"))
    return rounded(S.quantile_band(slopes, "slope", ["cell"]), "mean", "low", "high")


@R.query()
def sar_qmle(spark, sf_dir):
    """Spatial autoregression of ten assets on the energy field."""
    panel, w = group_daily(spark, sf_dir), kept(rbf(spark, sf_dir), "field")  # the field is made once, not for every sum
    roster = sorted(r[0] for r in w.select("target").distinct().collect())
    mean = panel.groupBy("ticker").agg(F.avg("return").alias("m"))
    centred = panel.join(mean, "ticker").withColumn("return", F.col("return") - F.col("m")).drop("m")
    fit = X.sar_qmle(X.lag_moments(centred, w).first(), np.linalg.eigvals(X.matrix(w, roster)))
    return rounded(spark.createDataFrame([(fit.rho, fit.se, fit.loglik, fit.n)], "rho double, se double, loglik double, n long"), "rho", "se", "loglik")


@R.query()
def two_field_qmle(spark, sf_dir):
    from lodestrata.operators.fields import equal_support_field

    w = kept(rbf(spark, sf_dir), "field")
    e = equal_support_field(w, 0.1)
    roster = sorted(r[0] for r in w.select("target").distinct().collect())
    fit = X.two_field_qmle(X.two_field_gram(group_daily(spark, sf_dir), w, e), X.matrix(w, roster), X.matrix(e, roster))
    return rounded(spark.createDataFrame([fit], "theta double, rho double, loglik double, sigma2 double"), "theta", "rho", "loglik", "sigma2")


@R.query()
def stationary_bootstrap(spark, sf_dir):
    """Mean daily total under 2,000 stationary paths."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("Date")).agg(F.sum("value").alias("x")).withColumn("position", (F.row_number().over(Window.partitionBy().orderBy("Date")) - 1).cast("long"))
    n = e.count()
    draws = S.resampled(e.select("position", "x"), S.index_table(spark, n, 2000, 5, 9)).groupBy("draw").agg(F.avg("x").alias("mean")).withColumn("cell", F.lit("all"))
    return rounded(S.quantile_band(draws, "mean", ["cell"]), "mean", "low", "high")


def segment_levels(spark, sf_dir) -> DataFrame:
    """Market segments as economies, regions as firms, four kinds of nations as activities: opportunity by mean balance."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    met = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy(F.col("c_mktsegment").alias("economy"), F.col("n_regionkey").alias("firm"), (F.col("n_nationkey") % 4).cast("int").alias("activity")).agg((1 + F.avg("c_acctbal") / 1e4).alias("level"))


@R.query()
def simulated_paths(spark, sf_dir):
    """Intensities of an economy for each market segment, under seeded news."""
    return rounded(simulation.simulate(segment_levels(spark, sf_dir), 3), "intensity")


@R.query()
def split_half_energy(spark, sf_dir):
    """Energy distance of the two halves of each item, against the smallest between items."""
    c = clouds(spark, sf_dir).withColumn("item", F.concat_ws("/", F.col("item").cast("string"), (F.col("key") % 2).cast("string")))
    d = D.energy(c).where("item_i < item_j").withColumn("same", F.split("item_i", "/")[0] == F.split("item_j", "/")[0])
    return rounded(d.groupBy("same").agg(F.min("value").alias("low"), F.max("value").alias("high")), "low", "high")
