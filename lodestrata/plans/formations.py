"""Queries over portfolio formations, certificates by draw, barycentres of groups and spatial moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import comparisons as C
from lodestrata.operators import fields, panels, studies
from lodestrata.operators import portfolios as P
from lodestrata.operators import spatial as X
from lodestrata.plans.clouds import R as CLOUDS
from lodestrata.plans.clouds import group_daily, rbf
from lodestrata.plans.panels import daily
from lodestrata.plans.register import Registry, rounded
from lodestrata.shared import kept
from lodestrata.sources.tables import table

LOOKBACK, HORIZON, STEP = 10, 5, 7

R = Registry(
    **CLOUDS.common,
    gd="SELECT CAST(user_id % 10 AS VARCHAR) AS t, CAST(ts AS DATE) AS d, sum(value) AS x FROM events GROUP BY 1, 2",
    cal="SELECT d, row_number() OVER (ORDER BY d) AS p FROM (SELECT DISTINCT d FROM gd)",
    fm=f"SELECT d AS formation, p AS f FROM cal WHERE p % {STEP} = 4 AND p > {LOOKBACK} AND p + {HORIZON - 1} <= (SELECT count(*) FROM cal)",
    tr=f"SELECT formation, t, stddev_samp(x) AS s FROM fm JOIN cal ON p BETWEEN f - {LOOKBACK} AND f - 1 JOIN gd USING (d) GROUP BY 1, 2 HAVING count(*) = {LOOKBACK}",
    wt="SELECT formation, 'equal' AS portfolio, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY formation) AS w FROM tr UNION ALL SELECT formation, 'inverse_volatility', t, (1 / s) / sum(1 / s) OVER (PARTITION BY formation) FROM tr",
)
QUERIES, ORACLE_SQL = R.queries, R.sql


def formed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A panel, the dates at which portfolios are formed, and their weights."""
    p = kept(group_daily(spark, sf_dir).withColumn("ticker", F.col("ticker").cast("string")), "panel")
    dates = p.select("Date").distinct().withColumn("position", F.row_number().over(Window.partitionBy().orderBy("Date")))  # a calendar
    f = kept(dates.where((F.col("position") % STEP == 4) & (F.col("position") > LOOKBACK) & (F.col("position") + (HORIZON - 1) <= dates.count())), "formations")
    return p, f, kept(studies.formation_weights(p, f, LOOKBACK, HORIZON), "weights")


@R.query("SELECT formation, portfolio, t AS ticker, [[w]] AS weight FROM wt", text=("formation",))
def formation_weights(spark, sf_dir):
    """Equal and inverse-volatility weights of each formation, from the dates before it alone."""
    return rounded(formed(spark, sf_dir)[2].where("portfolio <> 'minimum_variance'"), "weight")


@R.query(f"""
WITH fw AS (SELECT formation, portfolio, cal.d, sum(w * x) AS r FROM fm JOIN cal ON p BETWEEN f AND f + {HORIZON - 1} JOIN gd USING (d) JOIN wt USING (formation, t) GROUP BY 1, 2, 3), v AS (SELECT portfolio, avg(v) AS variance FROM (SELECT portfolio, formation, var_samp(r) AS v FROM fw GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT portfolio, avg(c) AS concentration FROM (SELECT portfolio, formation, sum(w * w) AS c FROM wt GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT a.portfolio, a.formation, b.t, coalesce(w, 0) AS w FROM (SELECT DISTINCT portfolio, formation FROM wt) a JOIN (SELECT DISTINCT portfolio, t FROM wt) b USING (portfolio) LEFT JOIN wt ON wt.portfolio = a.portfolio AND wt.formation = a.formation AND wt.t = b.t),
m AS (SELECT portfolio, avg(d) AS turnover FROM (SELECT portfolio, formation, 0.5 * sum(d) AS d FROM (SELECT *, abs(w - lag(w) OVER (PARTITION BY portfolio, t ORDER BY formation)) AS d FROM g) GROUP BY 1, 2) GROUP BY 1)
SELECT portfolio, [[variance]] AS variance, [[concentration]] AS concentration, [[turnover]] AS turnover FROM v JOIN c USING (portfolio) JOIN m USING (portfolio)
""")
def formation_summary(spark, sf_dir):
    """Mean forward variance, concentration and one-way turnover of each kind of portfolio over all formations."""
    p, f, w = formed(spark, sf_dir)
    return rounded(studies.formation_evaluation(p, f, w.where("portfolio <> 'minimum_variance'"), LOOKBACK, HORIZON), "variance", "concentration", "turnover")


@R.query("SELECT formation, true AS lowest FROM tr GROUP BY 1", text=("formation",))
def formation_floor(spark, sf_dir):
    """In its own trailing window no long-only portfolio has a lower variance than the minimum-variance one."""
    p, f, w = formed(spark, sf_dir)
    trailing = panels.trailing_and_forward(p, f, p, LOOKBACK, HORIZON).where("side = 'trailing'")
    r = trailing.join(w, ["formation", "ticker"]).groupBy("formation", "portfolio", "Date").agg(F.sum(F.col("weight") * F.col("return")).alias("r"))
    v = r.groupBy("formation", "portfolio").agg(F.var_samp("r").alias("v")).groupBy("formation").agg(F.min(F.when(F.col("portfolio") == "minimum_variance", F.col("v"))).alias("own"), F.min("v").alias("least"))
    return v.select("formation", (F.col("own") <= F.col("least") * (1 + 1e-9)).alias("lowest"))


@R.query("WITH b AS (SELECT p_size AS z, p_brand AS b, avg(p_retailprice) / 1e3 AS v FROM part GROUP BY 1, 2) SELECT CAST(z AS BIGINT) AS draw, count(*) AS tickers, true AS whole, [[(max(v) - min(v)) ** 2 / 4]] AS credit FROM b GROUP BY 1")
def certificate_by_draw(spark, sf_dir):
    """Certificate weights solved for each size of parts: on a line, all the credit lies in the two ends."""
    b = kept(table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("draw"), F.col("p_brand").alias("b")).agg((F.avg("p_retailprice") / 1e3).alias("v")), "lines")
    d = kept(b.toDF("draw", "item_i", "x").join(b.toDF("draw", "item_j", "y"), "draw").select("draw", "item_i", "item_j", ((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("value")), "squares")
    w = kept(studies.weight_stability(d), "weights")
    i, j = w.select("draw", F.col("ticker").alias("item_i"), F.col("weight").alias("q_i")), w.select("draw", F.col("ticker").alias("item_j"), F.col("weight").alias("q_j"))
    credit = d.join(i, ["draw", "item_i"]).join(j, ["draw", "item_j"]).groupBy("draw").agg((0.5 * F.sum(F.col("q_i") * F.col("q_j") * F.col("value"))).alias("credit"))
    sums = w.groupBy("draw").agg(F.count("*").alias("tickers"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("whole"))
    return rounded(sums.join(credit, "draw"), "credit")


@R.query("""
WITH q AS (SELECT year(o_orderdate) AS y, o_orderpriority AS item, quarter(o_orderdate) AS k, avg(o_totalprice) / 1e5 AS v FROM orders GROUP BY 1, 2, 3), r AS (SELECT y, v, row_number() OVER (PARTITION BY y, item ORDER BY v) AS p FROM q)
SELECT CAST(y AS INTEGER) AS year, CAST(p AS INTEGER) AS place, [[avg(v)]] AS point, true AS settled FROM r GROUP BY 1, 2
""")
def free_support_by_year(spark, sf_dir):
    """Barycentres of the priorities' quarters in each year: on a line, the means of equal ranks."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("group"), F.col("o_orderpriority").alias("item"), F.quarter("o_orderdate").alias("key")).agg(F.array(F.avg("o_totalprice") / 1e5).alias("v"))
    x = fields.free_support_barycentres(o).withColumn("point", F.col("point")[0])
    return rounded(x.select(F.col("group").alias("year"), F.row_number().over(Window.partitionBy("group").orderBy("point")).alias("place"), "point", "settled"), "point")


@R.query("WITH a AS (SELECT target, sum(weight) AS a FROM field GROUP BY 1), z AS (SELECT f.target, any_value(x.a) AS a, sum(f.weight * y.a) AS b FROM field f JOIN a x ON x.target = f.target JOIN a y ON y.target = f.candidate GROUP BY 1) SELECT count(*) AS n, [[sum(a)]] AS a, [[sum(b)]] AS b, [[sum(a * a)]] AS aa, [[sum(a * b)]] AS ab, [[sum(b * b)]] AS bb, 1 AS rank, true AS refused FROM z")
def gmm_instruments(spark, sf_dir):
    """Moments of the instruments of a field, their rank, and the refusal of an estimate from them."""
    w = kept(rbf(spark, sf_dir), "field")
    m = X.instrument_moments(w)
    try:
        X.sar_gmm(X.matrix(w, sorted(r[0] for r in w.select("target").distinct().collect())))
        refused = False
    except ValueError:
        refused = True
    return rounded(m, "a", "b", "aa", "ab", "bb").withColumns({"rank": F.lit(X.instrument_rank(m.first())), "refused": F.lit(refused)})


@R.query("""
WITH e AS (SELECT event_type AS t, CAST(ts AS DATE) AS d, sum(value) / 100 AS x, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT d, sum(x) FILTER (t = 'view') AS p, sum(x) FILTER (t <> 'view') AS q, sum(n) / 10.0::DOUBLE AS f FROM e GROUP BY 1), m AS (SELECT var_pop(p) AS a, covar_pop(p, q) AS c, var_pop(q) AS b, avg(p) / 10 AS u, avg(q) / 10 AS v, var_pop(f) AS f FROM a WHERE p IS NOT NULL AND q IS NOT NULL),
s AS (SELECT a + f * u * u AS a, c + f * u * v AS c, b + f * v * v AS b, 1 / (0.91::DOUBLE * 0.91) AS k FROM m)
SELECT [[k * (a + 0.6 * c + 0.09 * b)]] AS a, [[k * (0.3 * a + 1.09 * c + 0.3 * b)]] AS c, [[k * (0.09 * a + 0.6 * c + b)]] AS b FROM s
""")
def spatial_covariance_two(spark, sf_dir):
    """Covariance of two assets that each load on the other, with one factor: in closed form, as shrinkage leaves two series alone."""
    p = daily(spark, sf_dir).groupBy("Date", F.when(F.col("ticker") == "view", "a").otherwise("b").alias("ticker")).agg((F.sum("return") / 100).alias("return"))
    p = kept(panels.complete_case(p), "two")
    counts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("Date")).agg((F.count("*") / 10.0).alias("f"))
    f = counts.join(p.select("Date").distinct(), "Date").agg(F.var_pop("f")).first()[0]
    loads = {r["ticker"]: r["m"] for r in p.groupBy("ticker").agg((F.avg("return") / 10).alias("m")).collect()}
    (x,) = C.grid_of(p, ["a", "b"], ["return"])
    s = X.spatial_covariance(0.3, np.array([[0.0, 1.0], [1.0, 0.0]]), x, np.array([[loads["a"]], [loads["b"]]]), np.array([[f]]))
    return rounded(spark.createDataFrame([(float(s[0, 0]), float(s[0, 1]), float(s[1, 1]))], "a double, c double, b double"), "a", "c", "b")
