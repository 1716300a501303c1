"""Queries over dated panels. Stand-ins: event types as tickers, their daily sums as returns; order days as a calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ranks import keep_first, linear_quantiles
from lodestrata.operators import panels as P
from lodestrata.plans.register import Registry, rounded
from lodestrata.sources.tables import table

DAY = dt.date
R = Registry(
    daily="SELECT event_type AS ticker, CAST(ts AS DATE) AS \"Date\", sum(value) AS x FROM events GROUP BY 1, 2",
    user_daily="SELECT user_id AS ticker, CAST(ts AS DATE) AS \"Date\", sum(value) AS x FROM events GROUP BY 1, 2",
    spend="SELECT CAST(o_orderdate AS DATE) AS \"Date\", sum(o_totalprice) AS x FROM orders GROUP BY 1",
)
QUERIES, ORACLE_SQL = R.queries, R.sql


def daily(spark: SparkSession, sf_dir: str, key: str = "event_type", name: str = "return") -> DataFrame:
    """(ticker, Date, return): daily sums of events."""
    return table(spark, sf_dir, "events").groupBy(F.col(key).alias("ticker"), F.to_date("ts").alias("Date")).agg(F.sum("value").alias(name))


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.sum("o_totalprice").alias("x"))


@R.query('SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, [[covar_samp(a.x, b.x)]] AS covariance, [[corr(a.x, b.x)]] AS correlation, [[var_samp(a.x)]] AS variance_i, [[var_samp(b.x)]] AS variance_j FROM daily a JOIN daily b USING ("Date") WHERE (SELECT count(DISTINCT ticker) FROM daily) = (SELECT count(*) FROM daily c WHERE c."Date" = a."Date") GROUP BY 1, 2')
def covariance_long(spark, sf_dir):
    cols = ("covariance", "correlation", "variance_i", "variance_j")
    return rounded(P.covariance_long(P.complete_case(daily(spark, sf_dir))), *cols)


@R.query('SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, [[corr(a.x, b.x)]] AS correlation, [[sqrt(2 * (1 - greatest(least(corr(a.x, b.x), 1), -1)))]] AS chord FROM daily a JOIN daily b USING ("Date") WHERE a.ticker < b.ticker GROUP BY 1, 2')
def covariance_upper(spark, sf_dir):
    from lodestrata.functions.arrays import chord

    c = P.upper(P.covariance_long(daily(spark, sf_dir)))
    return rounded(c.select("ticker_i", "ticker_j", "correlation", chord("correlation").alias("chord")), "correlation", "chord")


@R.query('SELECT ticker, "Date", [[x]] AS "return" FROM daily d WHERE (SELECT count(*) FROM daily c WHERE c."Date" = d."Date") = (SELECT count(DISTINCT ticker) FROM daily)', text=("Date",))
def complete_case_panel(spark, sf_dir):
    return rounded(P.complete_case(daily(spark, sf_dir)), "return")


@R.query("SELECT ticker, CASE WHEN count(*) >= 2 THEN [[stddev_samp(x)]] END AS volatility FROM user_daily GROUP BY ticker")
def volatility_min2(spark, sf_dir):
    return rounded(P.volatility(daily(spark, sf_dir, "user_id")), "volatility")


@R.query("""
WITH seam AS (
  SELECT ticker, "Date", x, 0 AS src FROM daily WHERE "Date" <= DATE '2024-01-20' UNION ALL SELECT ticker, "Date", 2 * x, 1 FROM daily WHERE "Date" >= DATE '2024-01-15'
), kept AS (SELECT ticker, "Date", x FROM seam QUALIFY row_number() OVER (PARTITION BY ticker, "Date" ORDER BY src, x) = 1
), chg AS (SELECT ticker, "Date", x / lag(x) OVER (PARTITION BY ticker ORDER BY "Date") - 1 AS r FROM kept
), sel AS (SELECT * FROM chg WHERE "Date" >= DATE '2024-01-10' AND r IS NOT NULL)
SELECT ticker, "Date", [[r]] AS "return" FROM sel s WHERE (SELECT count(*) FROM sel c WHERE c."Date" = s."Date") = (SELECT count(DISTINCT ticker) FROM chg WHERE "Date" >= DATE '2024-01-10')
""", text=("Date",))
def pct_change_seam(spark, sf_dir):
    """Train and evaluation prices overlap; the first of a date stays, returns are recomputed, then dates are filtered."""
    p = daily(spark, sf_dir, name="close_price")
    train, later = p.where(F.col("Date") <= F.lit(DAY(2024, 1, 20))), p.where(F.col("Date") >= F.lit(DAY(2024, 1, 15))).withColumn("close_price", 2 * F.col("close_price"))
    return rounded(P.aligned_returns(train, later, start=DAY(2024, 1, 10)), "return")


@R.query("""
WITH seam AS (
  SELECT ticker, "Date", x, 0 AS src FROM daily WHERE "Date" <= DATE '2024-01-20' UNION ALL SELECT ticker, "Date", 2 * x, 1 FROM daily WHERE "Date" >= DATE '2024-01-15'
), kept AS (SELECT ticker, "Date", x FROM seam QUALIFY row_number() OVER (PARTITION BY ticker, "Date" ORDER BY src DESC, x) = 1)
SELECT ticker, "Date", [[x]] AS "return" FROM kept s WHERE (SELECT count(*) FROM kept c WHERE c."Date" = s."Date") = (SELECT count(DISTINCT ticker) FROM kept)
""", text=("Date",))
def chronological_keep_last(spark, sf_dir):
    p = daily(spark, sf_dir)
    first, later = p.where(F.col("Date") <= F.lit(DAY(2024, 1, 20))), p.where(F.col("Date") >= F.lit(DAY(2024, 1, 15))).withColumn("return", 2 * F.col("return"))
    return rounded(P.chronological_returns(first, later), "return")


@R.query('SELECT ticker, "Date", [[sum(ln(1 + x / 1e6)) OVER (PARTITION BY ticker ORDER BY "Date")]] AS cumulative FROM daily', text=("Date",))
def cumulative_log(spark, sf_dir):
    p = daily(spark, sf_dir).withColumn("return", F.col("return") / 1e6)
    ends = p.agg(F.min("Date").alias("a"), F.max("Date").alias("b"), F.count_distinct("Date").alias("n")).first()
    return rounded(P.calendar_returns(p, ends["a"], ends["b"], ends["n"]).select("ticker", "Date", "cumulative"), "cumulative")


@R.query("""
WITH n AS (SELECT "Date", row_number() OVER (ORDER BY "Date") AS p, count(*) OVER () AS n FROM spend)
SELECT min("Date") AS "Date", min(p) AS position FROM n GROUP BY date_trunc('month', "Date"), n HAVING min(p) > 21 AND min(p) + 4 <= n
""", text=("Date",))
def monthly_first_date(spark, sf_dir):
    return P.first_of_month(spend(spark, sf_dir), 21, 5).withColumn("position", F.col("position").cast("long"))


@R.query("""
WITH n AS (SELECT "Date", x, row_number() OVER (ORDER BY "Date") AS p, count(*) OVER () AS n FROM spend),
f AS (SELECT min("Date") AS formation, min(p) AS f FROM n GROUP BY date_trunc('month', "Date"), n HAVING min(p) > 21 AND min(p) + 4 <= n)
SELECT formation, CASE WHEN p < f THEN 'trailing' ELSE 'forward' END AS side, count(*) AS n, [[avg(x)]] AS mean FROM f JOIN n ON p BETWEEN f - 21 AND f + 4 GROUP BY 1, 2
""", text=("formation",))
def trailing_forward_windows(spark, sf_dir):
    s = spend(spark, sf_dir)
    w = P.trailing_and_forward(s, P.first_of_month(s, 21, 5), s, 21, 5)
    return rounded(w.groupBy("formation", "side").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "mean")


@R.query("SELECT n_name AS symbol, CAST(year(o_orderdate) AS INTEGER) AS year, count(o_orderkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def firm_year_counts(spark, sf_dir):
    """Counts by symbol and year; a symbol without rows has a null year, never a made-up zero year."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    # counted by customer before any join, so the nation join sees one row for each customer and year
    per = o.groupBy("o_custkey", "year").agg(F.count("*").alias("n"))
    found = per.join(c, per["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey", "year").agg(F.sum("n").alias("n"))
    quiet = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").groupBy("c_nationkey").agg(F.lit(None).cast("int").alias("year"), F.lit(0).cast("long").alias("n"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("symbol"))
    both = found.unionByName(quiet)
    out = F.broadcast(names).join(both, "c_nationkey", "left")
    return out.groupBy("symbol", "year").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


@R.query("SELECT coalesce(r_name, 'all') AS sector, count(*) AS n, [[avg(s_acctbal)]] AS mean, [[median(s_acctbal)]] AS median FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)")
def sample_descriptives_by_region(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    place = F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "r_name"))
    rows = s.join(place, s["s_nationkey"] == place["n_nationkey"])
    return rounded(rows.rollup("r_name").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("mean"), F.median("s_acctbal").alias("median")).select(F.coalesce("r_name", F.lit("all")).alias("sector"), "n", "mean", "median"), "mean", "median")


@R.query("SELECT c_custkey AS ticker, CAST(coalesce(max(CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' THEN 1 ELSE 0 END), 0) AS INTEGER) AS flag FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def inside_window_flag(spark, sf_dir):
    roster = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("Date"))
    return P.inside_window(rows, roster, DAY(1997, 3, 1), DAY(1997, 3, 31))


@R.query('SELECT ticker, "Date", [[x / stddev_samp(x) OVER (PARTITION BY ticker)]] AS standardized FROM daily', text=("Date",))
def standardized_returns(spark, sf_dir):
    return rounded(P.standardized(daily(spark, sf_dir)).select("ticker", "Date", "standardized"), "standardized")


@R.query("""
WITH m AS (SELECT ticker, "Date", x - avg(x) OVER (PARTITION BY ticker) AS d, row_number() OVER (PARTITION BY ticker ORDER BY "Date") AS t, count(*) OVER (PARTITION BY ticker) AS n FROM daily),
acf AS (SELECT a.ticker, b.t - a.t AS lag, sum(a.d * b.d) / (SELECT sum(d * d) FROM m c WHERE c.ticker = a.ticker) AS acf FROM m a JOIN m b ON a.ticker = b.ticker AND b.t > a.t AND b.t - a.t <= 50 GROUP BY 1, 2)
SELECT ticker, CAST(coalesce(min(CASE WHEN acf < 0.1 THEN lag END), ceil(cbrt((SELECT max(n) FROM m WHERE m.ticker = acf.ticker)))) AS BIGINT) AS block_length FROM acf GROUP BY ticker
""")
def stationary_block_length(spark, sf_dir):
    return P.autocorrelation_block_length(daily(spark, sf_dir))


@R.query("""
WITH f AS (SELECT "Date", sum(x) / 1e3 AS mkt, 0.5 AS rf FROM daily WHERE ticker <> 'view' GROUP BY 1)
SELECT ticker, count(*) AS n, [[avg(x - rf)]] AS mean_excess, [[regr_slope(x - rf, mkt)]] AS beta FROM daily JOIN f USING ("Date") GROUP BY ticker
""")
def factor_alignment(spark, sf_dir):
    p = daily(spark, sf_dir)
    f = p.where("ticker <> 'view'").groupBy("Date").agg((F.sum("return") / 1e3).alias("MKT"), F.lit(0.5).alias("RF"))
    a = P.align_factors(p, f, minimum=2)
    return rounded(a.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("excess").alias("mean_excess"), F.regr_slope("excess", "MKT").alias("beta")), "mean_excess", "beta")


@R.query("SELECT event_type, [[quantile_cont(value, 0.025)]] AS q025, [[quantile_cont(value, 0.5)]] AS q500, [[quantile_cont(value, 0.975)]] AS q975, count(*) AS n FROM events GROUP BY 1")
def linear_quantile_table(spark, sf_dir):
    q = linear_quantiles("value", [0.025, 0.5, 0.975])
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(q.alias("q"), F.count("*").alias("n"))
    return rounded(e.select("event_type", F.col("q")[0].alias("q025"), F.col("q")[1].alias("q500"), F.col("q")[2].alias("q975"), "n"), "q025", "q500", "q975")


@R.query("SELECT user_id, event_type, [[value]] AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return rounded(keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value"), "value")


@R.query("""SELECT CAST("Date" AS DATE) AS "Date", [[max(x) FILTER (ticker = 'click')]] AS click, [[max(x) FILTER (ticker = 'view')]] AS "view" FROM daily GROUP BY 1""", text=("Date",))
def pivot_panel(spark, sf_dir):
    p = daily(spark, sf_dir)
    return rounded(P.wide(p.where(F.col("ticker").isin("click", "view")), ["click", "view"]), "click", "view") if not p.where(F.col("ticker") == "click").isEmpty() else P.wide(p, ["click", "view"])


@R.query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, [[sum(value)]] AS total FROM events GROUP BY 1, 2", text=("start",))
def hourly_event_windows(spark, sf_dir):
    from lodestrata.streaming.windows import event_windows

    return rounded(event_windows(table(spark, sf_dir, "events"), "1 hour").select("event_type", "start", "n", "total"), "total")
