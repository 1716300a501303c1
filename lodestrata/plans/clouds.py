"""Queries over clouds of vectors and the fields built on them. Stand-in: an embedding's label is its item, vec_id its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import distances as D
from lodestrata.operators import fields
from lodestrata.operators import pairs as P
from lodestrata.plans.register import Registry, r6, rounded
from lodestrata.shared import kept
from lodestrata.sources import tables as T
from lodestrata.sources.tables import table

R = Registry(
    u="SELECT CAST(label AS INTEGER) AS item, vec_id AS key, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings",
    comp="SELECT a.item AS item_i, b.item AS item_j, avg(list_distance(a.v, b.v)) AS mean, any_value(0) AS z FROM u a, u b GROUP BY 1, 2",
    lin="SELECT a.item AS item_i, b.item AS item_j, avg(list_dot_product(a.v, b.v)) AS mean FROM u a, u b GROUP BY 1, 2",
    rbf="SELECT a.item AS item_i, b.item AS item_j, avg(exp(-(list_distance(a.v, b.v) ** 2) / 2)) AS mean FROM u a, u b GROUP BY 1, 2",
    nrg="SELECT c.item_i, c.item_j, CASE WHEN c.item_i = c.item_j THEN 0.0 ELSE 2 * c.mean - a.mean - b.mean END AS value FROM comp c JOIN comp a ON a.item_i = c.item_i AND a.item_j = c.item_i JOIN comp b ON b.item_i = c.item_j AND b.item_j = c.item_j",
    field="SELECT item_i AS target, item_j AS candidate, w / sum(w) OVER (PARTITION BY item_i) AS weight FROM (SELECT item_i, item_j, exp(-value / (SELECT median(value) FROM nrg WHERE item_i <> item_j)) AS w FROM nrg WHERE item_i <> item_j)",
    top="SELECT target, candidate, weight, row_number() OVER (PARTITION BY target ORDER BY weight DESC, candidate) AS rank FROM field QUALIFY row_number() OVER (PARTITION BY target ORDER BY weight DESC, candidate) <= 3",
    lagged="SELECT target, \"Date\", sum(weight * x) AS lag FROM (SELECT CAST(user_id % 10 AS INTEGER) AS ticker, CAST(ts AS DATE) AS \"Date\", sum(value) AS x FROM events GROUP BY 1, 2) JOIN field ON candidate = ticker GROUP BY 1, 2",
    cls="SELECT s_suppkey AS t, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS f, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(n_regionkey AS VARCHAR) END AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
QUERIES, ORACLE_SQL = R.queries, R.sql


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("item"), F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    return D.representation(e)


@R.query("SELECT item_i, item_j, [[value]] AS value FROM nrg")
def energy_v(spark, sf_dir):
    """Flagship: the energy distance of all pairs of clouds of unit rows."""
    return rounded(D.energy(clouds(spark, sf_dir)), "value")


@R.query("SELECT item_i, item_j, [[sqrt(greatest(value, 0))]] AS value FROM nrg")
def energy_metric(spark, sf_dir):
    return rounded(D.energy_metric(D.energy(clouds(spark, sf_dir))), "value")


@R.query("SELECT item_i, item_j, [[mean]] AS mean FROM comp")
def mean_ground_distance(spark, sf_dir):
    return rounded(D.pair_means(clouds(spark, sf_dir)).select("item_i", "item_j", "mean"), "mean")


@R.query("SELECT c.item_i, c.item_j, [[CASE WHEN c.item_i = c.item_j THEN 0.0 ELSE a.mean + b.mean - 2 * c.mean END]] AS value FROM lin c JOIN lin a ON a.item_i = c.item_i AND a.item_j = c.item_i JOIN lin b ON b.item_i = c.item_j AND b.item_j = c.item_j")
def mmd_linear(spark, sf_dir):
    return rounded(D.mmd(clouds(spark, sf_dir), "linear"), "value")


@R.query("SELECT c.item_i, c.item_j, [[CASE WHEN c.item_i = c.item_j THEN 0.0 ELSE sqrt(greatest(a.mean + b.mean - 2 * c.mean, 0)) END]] AS value FROM rbf c JOIN rbf a ON a.item_i = c.item_i AND a.item_j = c.item_i JOIN rbf b ON b.item_i = c.item_j AND b.item_j = c.item_j")
def mmd_rbf_rooted(spark, sf_dir):
    return rounded(D.mmd(clouds(spark, sf_dir), "rbf", 1.0, "rooted"), "value")


@R.query("SELECT item, [[mean]] AS v, CASE WHEN n > 1 THEN [[mean * n / (n - 1)]] END AS u FROM (SELECT item_i AS item, mean FROM comp WHERE item_i = item_j) JOIN (SELECT item, count(*) AS n FROM u GROUP BY 1) USING (item)")
def dispersion(spark, sf_dir):
    return rounded(D.within_terms(clouds(spark, sf_dir)), "v", "u")


@R.query("""
WITH m AS (SELECT item, k, avg(v[k]) AS x FROM u, range(1, 65) t(k) GROUP BY 1, 2), n AS (SELECT item, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT item, CAST(k - 1 AS INTEGER) AS k, [[x / n]] AS x FROM m JOIN n USING (item)
""")
def prototypes(spark, sf_dir):
    """Unit mean of the unit rows of each item, one row for each coordinate."""
    return rounded(D.prototypes(clouds(spark, sf_dir)).select("item", F.posexplode("v").alias("k", "x")), "x")


@R.query("SELECT a.key AS i, b.key AS j, [[list_distance(a.v, b.v)]] AS euclidean, [[1 - list_dot_product(a.v, b.v)]] AS cosine, [[acos(greatest(least(list_dot_product(a.v, b.v), 1), -1))]] AS angular FROM u a, u b WHERE a.key % 100 = 0 AND a.key <> b.key")
def point_distances(spark, sf_dir):
    """Every hundredth vector as a query against all others, in blocks of queries that meet blocks of rows."""
    c = clouds(spark, sf_dir)
    return D.query_distances(c.where("key % 100 = 0"), c, decimals=6)


@R.query("WITH n AS (SELECT item, key, v, row_number() OVER (ORDER BY item, key) - 1 AS p, count(*) OVER () AS n FROM u), s AS (SELECT * FROM n WHERE n <= 512 OR p IN (SELECT CAST(floor(k * (n - 1) / 511.0) AS BIGINT) FROM range(512) t(k))) SELECT [[median(list_distance(a.v, b.v))]] AS h FROM s a JOIN s b ON a.p < b.p WHERE a.v <> b.v")
def median_bandwidth(spark, sf_dir):
    h = D.median_bandwidth(clouds(spark, sf_dir))
    return spark.createDataFrame([(h,)], "h double").select(r6(F.col("h")).alias("h"))


@R.query("SELECT target, candidate, [[weight]] AS weight FROM field")
def rbf_median_field(spark, sf_dir):
    return rounded(rbf(spark, sf_dir), "weight")


def rbf(spark, sf_dir) -> DataFrame:
    return fields.rbf_field(D.energy(clouds(spark, sf_dir)))


@R.query("SELECT target, candidate, [[1.0 / count(*) OVER (PARTITION BY target)]] AS weight FROM field WHERE weight > 0.1")
def equal_support_field(spark, sf_dir):
    return rounded(fields.equal_support_field(rbf(spark, sf_dir), 0.1), "weight")


@R.query("SELECT t.target, t.candidate, [[t.weight]] AS weight, t.rank, [[1 - sum(t.weight) OVER (PARTITION BY t.target)]] AS other_mass, (SELECT count(*) FROM field f WHERE f.target = t.target) - 3 AS other_count FROM top t")
def topk_peers(spark, sf_dir):
    return rounded(fields.top_peers(rbf(spark, sf_dir), 3), "weight", "other_mass")


@R.query("""
WITH sz AS (SELECT *, count(f) OVER (PARTITION BY f) AS nf, count(c) OVER (PARTITION BY c) AS nc FROM cls), p AS (
  SELECT a.t AS target, b.t AS candidate FROM sz a JOIN cls b ON a.t <> b.t AND CASE WHEN a.f IS NOT NULL AND a.nf > 1 THEN a.f = b.f WHEN a.c IS NOT NULL AND a.nc > 1 THEN a.c = b.c ELSE true END)
SELECT target, candidate, [[1.0 / count(*) OVER (PARTITION BY target)]] AS weight FROM p
""")
def industry_fallback_field(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    u = s.join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"))
    u = u.select(F.col("s_suppkey").alias("ticker"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey").cast("string")).alias("industry"), F.when(F.col("s_suppkey") % 11 != 0, F.col("n_regionkey").cast("string")).alias("sector"))
    return fields.class_field(u, decimals=6)


@R.query("SELECT target, \"Date\", [[lag]] AS lag FROM lagged", text=("Date",))
def spatial_lag(spark, sf_dir):
    return rounded(fields.spatial_lag(group_daily(spark, sf_dir), rbf(spark, sf_dir)), "lag")


def group_daily(spark, sf_dir) -> DataFrame:
    """Ten groups of users as assets: (ticker, Date, return)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).cast("int").alias("ticker"), F.to_date("ts").alias("Date")).agg(F.sum("value").alias("return"))


@R.query("WITH e AS (SELECT target, candidate, 1.0 / count(*) OVER (PARTITION BY target) AS y FROM field WHERE weight > 0.1), b AS (SELECT target, candidate, coalesce(weight, 0) AS x, coalesce(y, 0) AS y FROM field LEFT JOIN e USING (target, candidate)), s AS (SELECT rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM b WHERE x > 0 AND y > 0) SELECT [[corr(x, y)]] AS pearson, [[sum(x * y) / sqrt(sum(x * x) * sum(y * y))]] AS cosine, (SELECT [[corr(rx, ry)]] FROM s) AS spearman, [[(SELECT avg(j) FROM (SELECT count(y) FILTER (y > 0) / count(*) AS j FROM b GROUP BY target))]] AS jaccard FROM b")
def weight_similarity(spark, sf_dir):
    w = kept(rbf(spark, sf_dir), "field")
    return rounded(fields.weight_similarity(w, fields.equal_support_field(w, 0.1)), "pearson", "cosine", "spearman", "jaccard")


@R.query("WITH f AS (SELECT a.target AS i, b.target AS j, sum(least(a.weight, b.weight)) AS s FROM field a JOIN field b ON a.candidate = b.candidate AND a.target < b.target GROUP BY 1, 2) SELECT [[1 - min(s)]] AS dobrushin FROM f")
def dobrushin_coefficient(spark, sf_dir):
    return rounded(fields.dobrushin(rbf(spark, sf_dir)), "dobrushin")


@R.query("SELECT a.target AS target, count(*) AS common FROM top a JOIN (SELECT item_i AS target, item_j AS candidate, row_number() OVER (PARTITION BY item_i ORDER BY mean, item_j) AS r FROM comp WHERE item_i <> item_j) b ON a.target = b.target AND a.candidate = b.candidate AND b.r <= 3 GROUP BY 1")
def peer_overlap_sets(spark, sf_dir):
    m = D.pair_means(clouds(spark, sf_dir))  # one pass over the pairs of points serves both definitions
    near = P.neighbours(m.select("item_i", "item_j", F.col("mean").alias("value")), 3).select(F.col("item_i").alias("target"), F.col("item_j").alias("candidate"), (-F.col("value")).alias("weight"))
    both = fields.peer_definitions({"energy": fields.top_peers(fields.rbf_field(D.from_component(m)), 3), "ground": near})
    return fields.basket_overlap(both).select("target", "common").where("common > 0")


@R.query("SELECT CAST(label AS INTEGER) AS item, count(*) AS rows, CAST(max(len(embedding)) AS BIGINT) AS dim, CAST(sum(len(list_filter(embedding, lambda x: isnan(x) OR x IS NULL))) AS BIGINT) AS nan_values, count(*) FILTER (list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') = 0) AS zero_rows, count(*) >= 40 AS ok, count(*) < 40 AS short FROM embeddings GROUP BY 1")
def cloud_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("item"), F.col("embedding").alias("v"))
    return T.coverage(e, 40, 64)


@R.query("""
WITH s AS (SELECT item, key, v[1:16] AS v FROM u), n AS (SELECT item, key, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM s),
c AS (SELECT a.item AS i, b.item AS j, avg(list_distance(a.v, b.v)) AS m FROM n a, n b GROUP BY 1, 2), d AS (SELECT c.i, c.j, 2 * c.m - x.m - y.m AS short FROM c JOIN c x ON x.i = c.i AND x.j = c.i JOIN c y ON y.i = c.j AND y.j = c.j WHERE c.i < c.j)
SELECT 16 AS width, [[corr(short, value)]] AS pearson FROM d JOIN nrg ON item_i = i AND item_j = j
""")
def prefix_preservation(spark, sf_dir):
    c = clouds(spark, sf_dir)
    return rounded(D.widths(c, D.energy(c), [16]), "pearson")



@R.query()
def wasserstein_w2(spark, sf_dir):
    """Order-2 Wasserstein distance of the first 128 rows of each item (of as many as the smallest item has)."""
    return rounded(D.wasserstein(*balanced(spark, sf_dir, 2)), "value")


def balanced(spark, sf_dir, order: int) -> tuple[DataFrame, int, int]:
    """The clouds, the order and the number of rows that a balanced problem takes of each."""
    c = clouds(spark, sf_dir)
    return c, order, min(128, c.groupBy("item").count().agg(F.min("count")).first()[0])


@R.query()
def wasserstein_w1(spark, sf_dir):
    return rounded(D.wasserstein(*balanced(spark, sf_dir, 1)), "value")


@R.query()
def energy_simplex_weights(spark, sf_dir):
    return rounded(fields.target_projections(D.pair_means(clouds(spark, sf_dir))), "weight", "gap", "value", "curvature")


@R.query()
def mmd_affine_weights(spark, sf_dir):
    return rounded(fields.target_projections(D.pair_means(clouds(spark, sf_dir), "linear"), "mmd", "affine"), "weight", "value", "curvature")


@R.query()
def wasserstein_simplex_weights(spark, sf_dir):
    c, _, m = balanced(spark, sf_dir, 2)
    return rounded(fields.wasserstein_projections(D.first_rows(c, m)), "weight", "gap", "value", "assignment_gap")


@R.query()
def wasserstein_simplex_weights_order_one(spark, sf_dir):
    c, _, m = balanced(spark, sf_dir, 1)
    return rounded(fields.wasserstein_projections(D.first_rows(c, m), 1), "weight", "gap", "value", "assignment_gap")


@R.query()
def random_support_null(spark, sf_dir):
    w = kept(rbf(spark, sf_dir), "field")
    return rounded(fields.support_null(fields.equal_support_field(w, 0.1), fields.equal_support_field(w, 0.11), 1000, 7), "jaccard")
