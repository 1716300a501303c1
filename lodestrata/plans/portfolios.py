"""Queries over portfolios and certificates. Stand-ins: event types as assets, supplier nations for vintages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import panels
from lodestrata.operators import portfolios as P
from lodestrata.plans.networks import brand_gaps
from lodestrata.plans.panels import daily
from lodestrata.plans.register import Registry, rounded
from lodestrata.sources.tables import table

R = Registry(
    daily="SELECT event_type AS ticker, CAST(ts AS DATE) AS \"Date\", sum(value) AS x FROM events GROUP BY 1, 2",
    vol="SELECT ticker, stddev_samp(x) AS s FROM daily GROUP BY 1",
    w="SELECT 'equal' AS portfolio, ticker, 1.0 / (SELECT count(*) FROM vol) AS weight FROM vol UNION ALL SELECT 'inverse_volatility', ticker, (1 / s) / (SELECT sum(1 / s) FROM vol) FROM vol",
    brand="SELECT p_brand AS b, p_size AS z, avg(p_retailprice) AS v FROM part GROUP BY 1, 2",
    gap="SELECT a.b AS i, c.b AS j, sqrt(sum((a.v - c.v) ** 2)) / 1e3 AS d FROM brand a JOIN brand c USING (z) GROUP BY 1, 2",
    q="SELECT p_brand AS ticker, sum(p_size) / (SELECT sum(p_size) FROM part) AS q FROM part GROUP BY 1",
    tw="SELECT CAST(year(o_orderdate) AS INTEGER) AS vintage, o_orderpriority AS ticker, sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY year(o_orderdate)) AS weight FROM orders WHERE NOT (year(o_orderdate) = 1997 AND o_orderpriority LIKE '1%') GROUP BY year(o_orderdate), o_orderpriority",
)
QUERIES, ORACLE_SQL = R.queries, R.sql


def weights(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = daily(spark, sf_dir)
    v = panels.volatility(p)
    return p, P.equal_weights(v).unionByName(P.inverse_volatility_weights(v))


def brands(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Distances between brands, and a portfolio of them by size."""
    g, _ = brand_gaps(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    total = part.agg(F.sum("p_size").alias("t"))
    q = part.groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_size").alias("s")).join(F.broadcast(total), F.lit(True)).select(F.lit("size").alias("portfolio"), "ticker", (F.col("s") / F.col("t")).alias("weight"))
    return g.withColumn("value", F.col("value") / 1e3), q


@R.query("SELECT portfolio, ticker, [[weight]] AS weight FROM w")
def inverse_vol_weights(spark, sf_dir):
    return rounded(weights(spark, sf_dir)[1], "weight")


@R.query('SELECT portfolio, [[var_samp(r)]] AS variance, count(*) AS dates FROM (SELECT portfolio, "Date", sum(weight * x) AS r FROM daily JOIN w USING (ticker) GROUP BY 1, 2) GROUP BY 1')
def portfolio_variance(spark, sf_dir):
    return rounded(panels.portfolio_variance(*weights(spark, sf_dir)), "variance")


@R.query("SELECT portfolio, [[1 / sum(weight * weight)]] AS effective FROM w GROUP BY 1")
def effective_number(spark, sf_dir):
    return rounded(P.effective_number(weights(spark, sf_dir)[1]), "effective")


@R.query("SELECT portfolio, ticker, [[weight * s / sum(weight * s) OVER (PARTITION BY portfolio)]] AS weight FROM w JOIN vol USING (ticker)")
def capital_to_budget(spark, sf_dir):
    p, w = weights(spark, sf_dir)
    return rounded(P.capital_to_budget(w, panels.volatility(p)), "weight")


@R.query("SELECT 'firm' AS kind, i AS name, [[sum(0.5 * a.q * b.q * d * d)]] AS credit FROM gap JOIN q a ON a.ticker = i JOIN q b ON b.ticker = j GROUP BY i UNION ALL SELECT 'sector', substr(i, 1, 7), [[sum(0.5 * a.q * b.q * d * d)]] FROM gap JOIN q a ON a.ticker = i JOIN q b ON b.ticker = j GROUP BY substr(i, 1, 7) UNION ALL SELECT 'pair', i || ' ' || j, [[a.q * b.q * d * d]] FROM gap JOIN q a ON a.ticker = i JOIN q b ON b.ticker = j WHERE i < j")
def credit_decomposition(spark, sf_dir):
    g, q = brands(spark, sf_dir)
    squared = g.withColumn("value", F.col("value") * F.col("value"))
    sectors = q.select("ticker", F.substring("ticker", 1, 7).alias("sector"))
    firm, pair, sector = P.credit_decomposition(squared, q, sectors)
    out = firm.select(F.lit("firm").alias("kind"), F.col("ticker").alias("name"), "credit").unionByName(sector.select(F.lit("sector").alias("kind"), F.col("sector").alias("name"), "credit")).unionByName(pair.select(F.lit("pair").alias("kind"), F.concat_ws(" ", "item_i", "item_j").alias("name"), "credit"))
    return rounded(out, "credit")


@R.query("SELECT 'size' AS portfolio, scale, slack, [[0.5 * sum(a.q * b.q * greatest(d / scale - 2 * slack, 0) ** 2)]] AS credit FROM gap JOIN q a ON a.ticker = i JOIN q b ON b.ticker = j, (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) s(scale), (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) t(slack) GROUP BY scale, slack")
def certificate_surface(spark, sf_dir):
    g, q = brands(spark, sf_dir)
    return rounded(P.certificate_surface(g, q, [1.0, 2.0], [0.0, 0.1]), "credit")


@R.query("""
WITH g AS (SELECT * FROM (SELECT DISTINCT vintage FROM tw), (SELECT DISTINCT ticker FROM tw)), f AS (SELECT vintage, ticker, coalesce(weight, 0) AS weight FROM g LEFT JOIN tw USING (vintage, ticker)), d AS (SELECT vintage, abs(weight - lag(weight) OVER (PARTITION BY ticker ORDER BY vintage)) AS d FROM f)
SELECT vintage, [[0.5 * sum(d)]] AS turnover FROM d GROUP BY 1
""")
def vintage_turnover(spark, sf_dir):
    return rounded(P.turnover(priority_weights(spark, sf_dir)), "turnover")


def priority_weights(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("vintage"), F.col("o_orderpriority").alias("ticker"), "o_totalprice").where("not (vintage = 1997 and ticker like '1%')")
    s = o.groupBy("vintage", "ticker").agg(F.sum("o_totalprice").alias("s"))
    t = s.groupBy("vintage").agg(F.sum("s").alias("t"))
    return s.join(t, "vintage").select("vintage", "ticker", (F.col("s") / F.col("t")).alias("weight"))


@R.query("WITH d AS (SELECT vintage, ticker, weight - lag(weight) OVER (PARTITION BY ticker ORDER BY vintage) AS change FROM tw) SELECT vintage, ticker, [[change]] AS change, row_number() OVER (PARTITION BY vintage ORDER BY abs(change) DESC, ticker) AS rank FROM d WHERE change IS NOT NULL")
def weight_change_rank(spark, sf_dir):
    return rounded(P.largest_changes(priority_weights(spark, sf_dir)).select("vintage", "ticker", "change", "rank"), "change")


@R.query("""
WITH dy AS (SELECT CAST(c_nationkey % 3 AS INTEGER) AS draw, CAST(c_custkey % 4 AS DOUBLE) AS weight, abs(c_acctbal) / 1e3 AS w2, (c_acctbal / 2e3) ** 2 AS cost FROM customer), g AS (SELECT *, greatest(w2 / scale - 2 * slack, 0) AS lo, scale * w2 + 2 * slack AS hi FROM dy, (VALUES (1.0::DOUBLE), (3.0::DOUBLE)) s(scale), (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) t(slack))
SELECT draw, scale, slack, [[sum(weight) FILTER (cost - hi * hi >= 0) / sum(weight)]] AS covered, [[coalesce(sum(weight) FILTER (NOT cost - hi * hi >= 0 AND cost - lo * lo < 0), 0) / sum(weight)]] AS violated, [[coalesce(sum(weight) FILTER (NOT cost - hi * hi >= 0 AND NOT cost - lo * lo < 0), 0) / sum(weight)]] AS unresolved FROM g GROUP BY 1, 2, 3 HAVING sum(weight) > 0
""".replace("sum(weight) FILTER (cost - hi * hi >= 0) /", "coalesce(sum(weight) FILTER (cost - hi * hi >= 0), 0) /"))
def exposure_envelope(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    dy = c.select((F.col("c_nationkey") % 3).cast("int").alias("draw"), (F.col("c_custkey") % 4).cast("double").alias("weight"), (F.abs("c_acctbal") / 1e3).alias("w2"), F.pow(F.col("c_acctbal") / 2e3, F.lit(2.0)).alias("cost"))
    return rounded(P.exposure_envelope(dy, [1.0, 3.0], [0.0, 0.5]), "covered", "violated", "unresolved")


@R.query("SELECT r.c_mktsegment AS design, CAST(n_nationkey AS VARCHAR) AS candidate, [[avg(CASE WHEN r.c_acctbal <= n_nationkey * 300.0 THEN 1.0 ELSE 0.0 END)]] AS share FROM customer r, nation GROUP BY 1, 2")
def reference_percentile(spark, sf_dir):
    r = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("design"), F.col("c_acctbal").alias("variance"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("candidate"), (F.col("n_nationkey") * 300.0).alias("candidate_variance"))
    return rounded(P.reference_percentile(r, c), "share")


@R.query("SELECT p_brand AS brand, p_partkey AS part, [[p_retailprice]] AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_holdings(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price")).orderBy(F.desc("price"), "part").limit(10), "price")


@R.query()
def minimum_variance_weights(spark, sf_dir):
    """Long-only minimum variance over event types: the covariance is n^2 numbers, solved on the driver."""
    import numpy as np

    rows = panels.covariance_long(panels.complete_case(daily(spark, sf_dir))).collect()
    names = sorted({r["ticker_i"] for r in rows})
    c = np.zeros((len(names), len(names)))
    for r in rows:
        c[names.index(r["ticker_i"]), names.index(r["ticker_j"])] = r["covariance"]
    w, gap = P.minimum_variance(c)
    return rounded(spark.createDataFrame([(n, float(x), gap) for n, x in zip(names, w, strict=True)], "ticker string, weight double, gap double"), "weight", "gap")


@R.query()
def reference_population(spark, sf_dir):
    """Variances of seeded random long-only portfolios."""
    p = panels.complete_case(daily(spark, sf_dir))
    names = sorted(r[0] for r in p.select("ticker").distinct().collect())
    d = P.reference_draws(names, 100, 11, 0.5, spark).withColumn("portfolio", F.col("draw").cast("string"))
    return rounded(panels.portfolio_variance(p, d.select("portfolio", "ticker", "weight")), "variance")
