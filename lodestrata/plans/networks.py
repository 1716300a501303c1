"""Queries over pair tables and networks. Stand-ins: two suppliers in one order are a co-mention in the order's year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import ranks
from lodestrata.operators import pairs as P
from lodestrata.operators import panels
from lodestrata.plans.panels import daily
from lodestrata.plans.register import Registry, r6, rounded
from lodestrata.sources.tables import table

R = Registry(
    seller="SELECT DISTINCT l_orderkey AS o, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem",
    pair_year="SELECT a.s AS firm_i, b.s AS firm_j, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM seller a JOIN seller b ON a.o = b.o AND a.s < b.s JOIN orders ON o_orderkey = a.o GROUP BY 1, 2, 3",
    adj="SELECT firm_i, firm_j, CAST(sum(count) AS BIGINT) AS weight, count(*) AS n_years, min(year) AS first_year, max(year) AS last_year FROM pair_year GROUP BY 1, 2 HAVING count(*) >= 3",
    edges="SELECT firm_i AS target, firm_j AS candidate, CAST(weight AS DOUBLE) AS weight FROM adj UNION ALL SELECT firm_j, firm_i, CAST(weight AS DOUBLE) FROM adj",
    scores="SELECT l_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, min_by(l_suppkey, (l_linenumber, l_suppkey)) AS g1, max_by(l_suppkey, (l_linenumber, l_suppkey)) AS g2, avg(l_discount * 0.7310585786) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2",
    cell="SELECT g1 AS gvkey1, g2 AS gvkey2, year, avg(score) AS score FROM scores GROUP BY 1, 2, 3",
    daily="SELECT event_type AS ticker, CAST(ts AS DATE) AS \"Date\", sum(value) AS x FROM events GROUP BY 1, 2",
    cum="SELECT ticker, \"Date\", sum(ln(1 + x / 1e6)) OVER (PARTITION BY ticker ORDER BY \"Date\") AS c FROM daily",
    gaps="SELECT a.ticker AS symbol1, b.ticker AS symbol2, sqrt(avg((a.c - b.c) ** 2)) AS rms, abs(max_by(a.c - b.c, \"Date\")) AS terminal FROM cum a JOIN cum b USING (\"Date\") WHERE a.ticker < b.ticker GROUP BY 1, 2",
    brand="SELECT p_brand AS b, p_size AS z, avg(p_retailprice) AS v FROM part GROUP BY 1, 2",
    gap1="SELECT a.b AS item_i, c.b AS item_j, sqrt(sum((a.v - c.v) ** 2)) AS value FROM brand a JOIN brand c USING (z) GROUP BY 1, 2",
    gap2="SELECT a.b AS item_i, c.b AS item_j, sum(abs(a.v - c.v)) AS value FROM brand a JOIN brand c USING (z) GROUP BY 1, 2",
)
QUERIES, ORACLE_SQL = R.queries, R.sql


def pair_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sellers by order, counted by year. The year joins the lines once, before pairs are formed."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").cast("string").alias("s"))
    when = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderdate").alias("created_date"))
    # one shuffle by order serves the sets and the join
    sold = lines.groupBy("o").agg(F.sort_array(F.collect_set("s")).alias("s")).where(F.size("s") > 1).join(when, "o")
    # an order has a handful of lines: its pairs come from its own array, without a self join
    pairs = sold.select("created_date", F.year("created_date").alias("publication_year"), F.explode(F.flatten(F.transform("s", lambda a, k: F.transform(F.slice("s", k + 2, F.size("s")), lambda b: F.struct(a.alias("firm_i"), b.alias("firm_j")))))).alias("p"))
    return P.co_mention_pairs(pairs.select("created_date", "publication_year", "p.firm_i", "p.firm_j"))


def brand_gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two distances between brands over their mean prices by size."""
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("b"), F.col("p_size").alias("z")).agg(F.avg("p_retailprice").alias("v"))
    met = b.toDF("item_i", "z", "x").join(b.toDF("item_j", "z", "y"), "z").groupBy("item_i", "item_j")
    d = F.col("x") - F.col("y")
    return met.agg(F.sqrt(F.sum(d * d)).alias("value")), met.agg(F.sum(F.abs(d)).alias("value"))


@R.query("SELECT * FROM pair_year")
def comention_pair_year(spark, sf_dir):
    return pair_years(spark, sf_dir)


@R.query("SELECT * FROM adj")
def comention_adjacency_having(spark, sf_dir):
    return P.adjacency(pair_years(spark, sf_dir), 3)


@R.query("SELECT target, candidate, [[weight / sum(weight) OVER (PARTITION BY target)]] AS weight FROM edges")
def comention_row_stochastic(spark, sf_dir):
    return rounded(P.row_normalized(P.mirrored(P.adjacency(pair_years(spark, sf_dir), 3))), "weight")


@R.query("SELECT count(*) AS pairs FROM (SELECT DISTINCT firm_i, firm_j FROM pair_year)")
def comention_distinct_pairs(spark, sf_dir):
    return pair_years(spark, sf_dir).select("firm_i", "firm_j").distinct().agg(F.count("*").alias("pairs"))


@R.query("SELECT firm_i, firm_j, weight, i.s_nationkey AS nation_i, j.s_nationkey AS nation_j, coalesce(i.s_nationkey = j.s_nationkey, false) AS same_nation FROM adj LEFT JOIN supplier i ON CAST(i.s_suppkey AS VARCHAR) = firm_i LEFT JOIN supplier j ON CAST(j.s_suppkey AS VARCHAR) = firm_j")
def lookup_endpoint_attributes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").alias("nation"))
    p = P.with_endpoints(P.adjacency(pair_years(spark, sf_dir), 3), s, "k", "firm_i", "firm_j")
    return p.select("firm_i", "firm_j", "weight", "nation_i", "nation_j", P.same("nation").alias("same_nation"))


@R.query("SELECT firm_i, firm_j, weight FROM adj WHERE firm_i IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 3000) AND firm_j IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 3000)")
def semi_join_both_endpoints(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_suppkey").cast("string").alias("k"))
    return P.in_roster(P.adjacency(pair_years(spark, sf_dir), 3), s, "k", "firm_i", "firm_j").select("firm_i", "firm_j", "weight")


@R.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')")
def anti_join_roster(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@R.query("SELECT a.firm_i, a.firm_j, a.count AS n_first, b.count AS n_second FROM pair_year a JOIN pair_year b USING (firm_i, firm_j) WHERE a.year = 1996 AND b.year = 1997")
def dyad_inner_join(spark, sf_dir):
    p = pair_years(spark, sf_dir)
    year = lambda y, n: p.where(F.col("year") == y).select("firm_i", "firm_j", F.col("count").alias(n))
    return P.dyads(year(1996, "n_first"), year(1997, "n_second"), key=("firm_i", "firm_j"))


def directed_scores(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("gvkey1"), F.max_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("gvkey2"), F.avg(F.col("l_discount") * 0.7310585786).alias("score"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    return l.join(o, "l_orderkey").groupBy("gvkey1", "gvkey2", "year").agg(F.avg("score").alias("score"))


@R.query("SELECT least(gvkey1, gvkey2) AS i, greatest(gvkey1, gvkey2) AS j, [[avg(score)]] AS score, count(*) AS n FROM cell WHERE gvkey1 <> gvkey2 GROUP BY 1, 2")
def directional_mean(spark, sf_dir):
    return rounded(P.directional_mean(directed_scores(spark, sf_dir)), "score")


@R.query("SELECT gvkey1, gvkey2, count(DISTINCT year) AS years, [[avg(score)]] AS score FROM cell WHERE gvkey1 <> gvkey2 GROUP BY 1, 2")
def directed_years(spark, sf_dir):
    return rounded(P.directed_years(directed_scores(spark, sf_dir)), "score")


@R.query("""
WITH v AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS vintage FROM orders), f AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS formation FROM orders WHERE o_orderdate >= TIMESTAMP '1995-04-02')
SELECT formation, max(vintage) AS vintage FROM f JOIN v ON vintage < formation GROUP BY 1
""", text=("formation", "vintage"))
def latest_vintage_strict(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate")
    v = o.select(F.trunc("o_orderdate", "quarter").alias("vintage")).distinct()
    f = o.where(F.col("o_orderdate") >= F.lit("1995-04-02").cast("timestamp")).select(F.trunc("o_orderdate", "month").alias("formation")).distinct()
    return P.latest_before(f, v)


@R.query("""
WITH a AS (SELECT user_id AS target, CAST(ts AS DATE) AS d, count(*) AS mass FROM events WHERE event_type = 'view' GROUP BY 1, 2), n AS (SELECT user_id AS target, CAST(ts AS DATE) AS d, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT t.target, [[coalesce((SELECT sum(a.mass * n.v) FROM a JOIN n ON a.target = n.target AND a.d > n.d WHERE a.target = t.target), 0)]] AS readout FROM (SELECT target FROM a UNION SELECT target FROM n) t
""")
def strict_tail(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), F.to_date("ts").alias("date"), "event_type", "value")
    a = e.where("event_type = 'view'").select("target", "date", F.lit(1.0).alias("mass"))
    return rounded(P.strict_tail(a, e.where("event_type = 'purchase'").select("target", "date", "value")), "readout")


@R.query("""
WITH a AS (SELECT event_type AS target, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT target, d, n / sum(n) OVER (PARTITION BY target) AS mass FROM a), n AS (SELECT event_type AS reference, CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT target, reference, CASE WHEN target <> reference THEN [[sum(mass * v)]] END AS readout FROM m JOIN n ON m.d > n.d GROUP BY 1, 2
""")
def count_tails(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rounded(P.count_tails(e.select(F.col("event_type").alias("target"), "date", "n"), e.select(F.col("event_type").alias("reference"), "date", "value")), "readout")


@R.query("""
WITH e AS (SELECT value, substr(item_i, 1, 7) AS i, substr(item_j, 1, 7) AS j FROM gap1 WHERE item_i < item_j), s AS (SELECT i AS sector, value, i = j AS b FROM e UNION ALL SELECT j, value, false FROM e WHERE i <> j)
SELECT sector, [[avg(value) FILTER (b)]] AS within, [[avg(value) FILTER (NOT b)]] AS "cross", count(*) FILTER (b) AS n_within, count(*) FILTER (NOT b) AS n_cross FROM s GROUP BY 1
""")
def sector_within_cross(spark, sf_dir):
    g, _ = brand_gaps(spark, sf_dir)
    labels = g.select(F.col("item_i").alias("ticker")).distinct().withColumn("sector", F.substring("ticker", 1, 7))
    p = g.where("item_i < item_j").select(F.col("item_i").alias("ticker_i"), F.col("item_j").alias("ticker_j"), "value")
    return rounded(P.sector_distances(p, labels), "within", "cross")


@R.query("SELECT substr(item_i, 1, 7) AS sector, item_i AS symbol1, item_j AS symbol2, [[value]] AS value FROM gap1 WHERE item_i < item_j AND substr(item_i, 1, 7) = substr(item_j, 1, 7) QUALIFY row_number() OVER (PARTITION BY substr(item_i, 1, 7) ORDER BY value, item_i, item_j) = 1")
def nearest_same_sector_pair(spark, sf_dir):
    g, _ = brand_gaps(spark, sf_dir)
    p = g.where("item_i < item_j").select(F.substring("item_i", 1, 7).alias("sector"), F.col("item_i").alias("symbol1"), F.col("item_j").alias("symbol2"), "value")
    return rounded(P.nearest_in_group(p.where(F.col("sector") == F.substring("symbol2", 1, 7)), "sector"), "value")


@R.query("SELECT symbol1, symbol2, [[rms]] AS rms, [[terminal]] AS terminal, row_number() OVER (ORDER BY rms, symbol1, symbol2) AS rank, [[100.0 * (row_number() OVER (ORDER BY rms, symbol1, symbol2) - 1) / (count(*) OVER () - 1)]] AS percentile FROM gaps")
def percentile_rank_pairs(spark, sf_dir):
    """RMS gaps of cumulative returns, and each pair's rank and percentile among all."""
    p = daily(spark, sf_dir).withColumn("return", F.col("return") / 1e6)
    ends = p.agg(F.min("Date").alias("a"), F.max("Date").alias("b"), F.count_distinct("Date").alias("n")).first()
    c = panels.calendar_returns(p, ends["a"], ends["b"], ends["n"])
    names = c.select("ticker").distinct()
    every = names.toDF("symbol1").join(names.toDF("symbol2"), F.col("symbol1") < F.col("symbol2"))
    return rounded(P.comparative_percentiles(P.pair_gaps(c, every)), "rms", "terminal", "percentile")


@R.query("SELECT item_i, item_j, [[value]] AS value, row_number() OVER (PARTITION BY item_i ORDER BY value, item_j) AS rank FROM gap1 WHERE item_i <> item_j QUALIFY row_number() OVER (PARTITION BY item_i ORDER BY value, item_j) <= 3")
def topk_neighbours(spark, sf_dir):
    return rounded(P.neighbours(brand_gaps(spark, sf_dir)[0], 3), "value").withColumn("rank", F.col("rank").cast("long"))


@R.query("""
WITH a AS (SELECT item_i, item_j, row_number() OVER (PARTITION BY item_i ORDER BY value, item_j) AS r FROM gap1 WHERE item_i <> item_j), b AS (SELECT item_i, item_j, row_number() OVER (PARTITION BY item_i ORDER BY value, item_j) AS r FROM gap2 WHERE item_i <> item_j)
SELECT a.item_i AS item, [[count(b.r) / 3.0]] AS overlap, coalesce(bool_or(a.r = 1 AND b.r = 1), false) AS same_nearest FROM a LEFT JOIN b ON a.item_i = b.item_i AND a.item_j = b.item_j AND b.r <= 3 WHERE a.r <= 3 GROUP BY 1
""")
def neighbour_recall(spark, sf_dir):
    return rounded(P.neighbour_recall(*brand_gaps(spark, sf_dir), 3), "overlap")


@R.query("SELECT item_i AS i, max_by(item_j, (value, -CAST(substr(item_j, 7) AS INTEGER))) AS partner, [[max(value)]] AS credit FROM gap1 WHERE item_i <> item_j GROUP BY 1")
def strongest_partner(spark, sf_dir):
    g, _ = brand_gaps(spark, sf_dir)
    return rounded(P.strongest_partner(g.select(F.col("item_i").alias("i"), F.col("item_j").alias("j"), F.col("value").alias("credit"))), "credit")


@R.query("""
WITH p AS (SELECT a.value AS x, b.value AS y FROM gap1 a JOIN gap2 b USING (item_i, item_j) WHERE item_i < item_j),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT [[corr(x, y)]] AS pearson, [[corr(rx, ry)]] AS spearman FROM r
""")
def rank_correlations(spark, sf_dir):
    a, b = brand_gaps(spark, sf_dir)
    p = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["item_i", "item_j"]).where("item_i < item_j")
    return rounded(P.rank_correlations(p, "x", "y"), "pearson", "spearman")


@R.query("""
WITH p AS (SELECT g.value AS distance, CASE WHEN substr(g.item_i, 1, 7) = substr(g.item_j, 1, 7) THEN 1 ELSE 0 END AS linked, CAST(substr(g.item_i, 7) AS INTEGER) % 7 AS years FROM gap1 g WHERE item_i < item_j),
r AS (SELECT *, rank() OVER (ORDER BY -distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0 AS rk, rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0 AS rd, rank() OVER (ORDER BY years) + (count(*) OVER (PARTITION BY years) - 1) / 2.0 AS ry FROM p)
SELECT [[(sum(rk) FILTER (linked = 1) - sum(linked) * (sum(linked) + 1) / 2.0) / (sum(linked) * (count(*) - sum(linked)))]] AS auc, [[corr(rd, ry)]] AS spearman, count(*) FILTER (linked = 1) AS linked, count(*) AS pairs FROM r
""")
def link_statistics(spark, sf_dir):
    g, _ = brand_gaps(spark, sf_dir)
    p = g.where("item_i < item_j").select(F.col("value").alias("distance"), F.when(F.substring("item_i", 1, 7) == F.substring("item_j", 1, 7), 1).otherwise(0).alias("linked"), (F.substring("item_i", 7, 99).cast("int") % 7).alias("years"))
    return rounded(P.link_statistics(p), "auc", "spearman")


@R.query("SELECT target, count(*) FILTER (a AND b) AS common, count(*) AS either, [[count(*) FILTER (a AND b) / count(*)]] AS jaccard, [[count(*) FILTER (a AND b) / count(*) FILTER (a)]] AS share_first FROM (SELECT target, candidate, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT CAST(o_custkey % 50 AS INTEGER) AS target, o_orderpriority AS candidate, 1 AS s FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT CAST(o_custkey % 50 AS INTEGER), o_orderpriority, 2 FROM orders WHERE o_totalprice < 20000) GROUP BY 1, 2) GROUP BY 1")
def support_jaccard(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("int").alias("target"), F.col("o_orderpriority").alias("candidate"), "o_totalprice")
    return rounded(P.set_overlap(o.where("o_totalprice > 400000"), o.where("o_totalprice < 20000")), "jaccard", "share_first")


@R.query("SELECT event_type, [[(sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)]] AS auc FROM (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM events) GROUP BY 1")
def auc_average_ranks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("y"))
    return rounded(ranks.auc(e, "value", "y", ("event_type",)), "auc")


@R.query("SELECT c_mktsegment, [[corr(rx, ry)]] AS spearman, count(*) AS n FROM (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS ry FROM customer) GROUP BY 1")
def spearman_average_ranks(spark, sf_dir):
    return rounded(ranks.spearman(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey", ("c_mktsegment",)), "spearman")


@R.query("WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN (p_retailprice % 100) / 1e5 END AS p FROM part), s AS (SELECT *, (count(*) OVER (PARTITION BY p IS NULL) - row_number() OVER (PARTITION BY p IS NULL ORDER BY p, p_partkey) + 1) * p AS st FROM p) SELECT p_partkey, CASE WHEN p IS NOT NULL THEN [[least(1.0, max(st) OVER (PARTITION BY p IS NULL ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING))]] END AS p_holm FROM s")
def holm_adjusted(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, (F.col("p_retailprice") % 100) / 1e5).alias("p"))
    return ranks.holm(p, "p").select("p_partkey", r6(F.col("p_holm")).alias("p_holm"))
