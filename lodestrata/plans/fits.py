"""Queries over fits: spatial autoregressions, projections, transports, moments and small solvers, where SQL has a closed form.

The spatial fits use the field of equal weights on all others, whose eigenvalues are 1 and -1 / (n - 1): SQL then finds the root of
the profile's derivative on two grids.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import comparisons as C
from lodestrata.operators import distances as D
from lodestrata.operators import fields, panels
from lodestrata.operators import ordination as O  # noqa: E741
from lodestrata.operators import portfolios as P
from lodestrata.operators import regression as G
from lodestrata.operators import simulation as S
from lodestrata.operators import spatial as X
from lodestrata.plans.clouds import R as CLOUDS
from lodestrata.plans.clouds import clouds, group_daily, rbf
from lodestrata.plans.inference import R as INFERENCE
from lodestrata.plans.inference import dyads, replications
from lodestrata.plans.panels import daily
from lodestrata.plans.register import Registry, rounded
from lodestrata.shared import kept
from lodestrata.sources.tables import table

ITEMS = 10


def derivative(rho: str) -> str:
    """The profile likelihood's derivative under equal weights on ITEMS - 1 others, from moments m."""
    return f"m.t * (-1 / (1 - ({rho})) + 1 / (1 + ({rho}) / {ITEMS - 1})) + m.n * (m.rw - ({rho}) * m.ww) / (m.rr - 2 * ({rho}) * m.rw + ({rho}) * ({rho}) * m.ww)"


def likelihood(rho: str) -> str:
    return f"(-0.5 * m.n * (ln(2 * pi() * (m.rr - 2 * ({rho}) * m.rw + ({rho}) * ({rho}) * m.ww) / m.n) + 1) + m.t * (ln(1 - ({rho})) + {ITEMS - 1} * ln(1 + ({rho}) / {ITEMS - 1})))"


def root(moments: str) -> str:
    """SQL of the root of the derivative."""
    first = f"SELECT arg_min(r, abs(g)) AS r FROM (SELECT k / 1e3 AS r, {derivative('k / 1e3')} AS g FROM range(-998, 999) t(k), {moments} m)"
    return f"SELECT arg_min(r, abs(g)) AS rho FROM (SELECT c.r + k / 1e6 AS r, {derivative('c.r + k / 1e6')} AS g FROM ({first}) c, range(-1000, 1001) t(k), {moments} m)"


R = Registry(
    **CLOUDS.common,
    **{k: INFERENCE.common[k] for k in ("brand", "dy", "rep")},
    gd="SELECT CAST(user_id % 10 AS INTEGER) AS t, CAST(ts AS DATE) AS d, sum(value) AS x FROM events GROUP BY 1, 2",
    gc="SELECT t, d, x - avg(x) OVER (PARTITION BY t) AS x FROM gd",
    gl="SELECT t, d, x, (sum(x) OVER (PARTITION BY d) - x) / 9.0 AS w FROM gc QUALIFY count(*) OVER (PARTITION BY d) > 1",
    gm="SELECT count(*) AS n, count(DISTINCT d) AS t, sum(x * x) AS rr, sum(x * w) AS rw, sum(w * w) AS ww FROM gl",
    gr=root("gm"),
    fd="SELECT CAST(ts AS DATE) AS d, count(*) / 100.0 AS f FROM events GROUP BY 1",
    gf="SELECT t, d, f, x, (sum(x) OVER (PARTITION BY d) - x) / 9.0 AS w FROM gd JOIN fd USING (d) QUALIFY count(*) OVER (PARTITION BY d) > 1",
    gs="SELECT t, d, f, x - regr_intercept(x, f) OVER (PARTITION BY t) - regr_slope(x, f) OVER (PARTITION BY t) * f AS x, w - regr_intercept(w, f) OVER (PARTITION BY t) - regr_slope(w, f) OVER (PARTITION BY t) * f AS w FROM gf",
    gq="SELECT count(*) AS n, count(DISTINCT d) AS t, sum(x * x) AS rr, sum(x * w) AS rw, sum(w * w) AS ww FROM gs",
    gz=root("gq"),
    u3="SELECT item % 3 AS item, key, v FROM u",
    c3="SELECT a.item AS i, b.item AS j, avg(list_distance(a.v, b.v)) AS a, avg(list_dot_product(a.v, b.v)) AS k FROM u3 a, u3 b GROUP BY 1, 2",
    r4="SELECT item, v, row_number() OVER (PARTITION BY item ORDER BY key) AS p FROM u QUALIFY row_number() OVER (PARTITION BY item ORDER BY key) <= 4",
    p4="SELECT x.k AS a, y.k AS b, z.k AS c, w.k AS d FROM range(1, 5) x(k), range(1, 5) y(k), range(1, 5) z(k), range(1, 5) w(k) WHERE x.k NOT IN (y.k, z.k, w.k) AND y.k NOT IN (z.k, w.k) AND z.k <> w.k",
    m4="SELECT i, j, a, b, c, d, avg(l) AS one, avg(l * l) AS two FROM (SELECT x.item AS i, y.item AS j, x.p, y.p AS q, list_distance(x.v, y.v) AS l FROM r4 x JOIN r4 y ON x.item < y.item) e JOIN p4 ON q = CASE p WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c ELSE d END GROUP BY ALL",
    six="SELECT CAST(user_id % 6 AS INTEGER) AS k, avg(value) AS x, avg(value * value) / 100 AS y, count(*) AS n FROM events GROUP BY 1",
    d6="SELECT a.k AS i, b.k AS j, abs(a.x - b.x) AS x, abs(a.y - b.y) + a.n / 1e3 + b.n / 1e3 AS y FROM six a JOIN six b ON a.k < b.k",
)
QUERIES, ORACLE_SQL = R.queries, R.sql


def rounded4(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in columns})


def equal_field(panel: DataFrame) -> DataFrame:
    """Equal weights on all other tickers of a panel, written down, as callers read them several times."""
    u = panel.select("ticker").distinct().withColumns({"industry": F.lit(None).cast("string"), "sector": F.lit(None).cast("string")})
    return kept(fields.class_field(kept(u, "tickers")), "equal-field")


def centred_groups(spark, sf_dir) -> DataFrame:
    p = group_daily(spark, sf_dir)
    mean = p.groupBy("ticker").agg(F.avg("return").alias("m"))
    return p.join(mean, "ticker").select("ticker", "Date", (F.col("return") - F.col("m")).alias("return")).transform(lambda df: kept(df, "centred"))


def roster_of(panel: DataFrame) -> list:
    return sorted(r[0] for r in panel.select("ticker").distinct().collect())


@R.query(f"SELECT round(rho, 4) AS rho, round({likelihood('rho')}, 2) AS loglik, round(1 / sqrt(-({likelihood('rho + h')} - 2 * {likelihood('rho')} + {likelihood('rho - h')}) / (h * h)), 3) AS se, m.n AS n FROM (SELECT rho, least(0.01, rho + 0.999, 0.999 - rho) AS h FROM gr), gm m")
def sar_equal_field(spark, sf_dir):
    """Spatial autoregression of ten assets, each on the mean of the others."""
    p = centred_groups(spark, sf_dir)
    w = equal_field(p)
    fit = X.sar_qmle(X.lag_moments(p, w).first(), np.linalg.eigvals(X.matrix(w, roster_of(p))))
    return spark.createDataFrame([(round(fit.rho, 4), round(fit.loglik, 2), round(fit.se, 3), fit.n)], "rho double, loglik double, se double, n long")


def factor_panel(spark, sf_dir) -> DataFrame:
    f = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("Date")).agg((F.count("*") / 100.0).alias("MKT"))
    return group_daily(spark, sf_dir).withColumnRenamed("return", "excess").join(f, "Date").transform(lambda df: kept(df, "factors"))


@R.query("SELECT round(rho, 4) AS rho FROM gz")
def sar_factor_equal_field(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    fit, _ = X.sar_factor_qmle(p, equal_field(p), ["MKT"], roster_of(p))
    return spark.createDataFrame([(round(fit.rho, 4),)], "rho double")


@R.query("SELECT round(rho, 4) AS rho, round(0.3 * rho, 4) AS rho_1, round(0.7 * rho, 4) AS rho_2 FROM gz")
def factor_two_field(spark, sf_dir):
    """Two fields with factors, at a fixed mixture of a field with itself, where the total is that of the one field."""
    p = factor_panel(spark, sf_dir)
    w = equal_field(p)
    fit, _ = C.factor_two_field_qmle(p, w, w, ["MKT"], roster_of(p), pinned=0.3)
    return spark.createDataFrame([tuple(round(fit[k], 4) for k in ("rho", "rho_1", "rho_2"))], "rho double, rho_1 double, rho_2 double")


@R.query(f"SELECT 'equal' AS operator, round(2 * ({likelihood('rho')} - {likelihood('0')}), 2) AS qlr, round(rho, 4) AS rho FROM gz, gq m WHERE (SELECT count(*) FROM gd) = 10 * (SELECT count(DISTINCT d) FROM gd) UNION ALL SELECT 'gaps', NULL, NULL WHERE (SELECT count(*) FROM gd) < 10 * (SELECT count(DISTINCT d) FROM gd)")
def spatial_value_ratio(spark, sf_dir):
    """The likelihood ratio of a spatial fit over factors alone; a panel with gaps is refused."""
    p = factor_panel(spark, sf_dir)
    roster = roster_of(p)
    try:
        r, f = C.grid_of(p, roster, ["excess", "MKT"])
    except ValueError:
        return spark.createDataFrame([("gaps", None, None)], "operator string, qlr double, rho double")
    summary, _ = C.spatial_value(spark, r, f[:, :1], {"equal": X.matrix(equal_field(p), roster)}, 19, 5, 3)
    return summary.select("operator", F.round("qlr", 2).alias("qlr"), F.round("rho", 4).alias("rho"))


@R.query('SELECT d AS "Date", [[-0.5 * count(*) * ln(2 * pi() * 400) + ln(1 - 0.3) + 9 * ln(1 + 0.3 / 9) - sum((x - 0.3 * w) ** 2) / 800]] AS score FROM gl GROUP BY 1', text=("Date",))
def held_out_scores(spark, sf_dir):
    p = centred_groups(spark, sf_dir)
    w = equal_field(p)
    fit = X.SpatialFit(0.3, 0.0, 400.0, 1, 1)
    return rounded(X.daily_log_scores(p, w, fit, np.linalg.eigvals(X.matrix(w, roster_of(p)))), "score")


@R.query("SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, [[(CASE WHEN a.k = b.k THEN 1 ELSE 0 END) / (1 + 0.25 / 9) + (0.25 / 9) / ((1 + 0.25 / 9) * (1 - 0.25))]] AS value FROM range(10) a(k), range(10) b(k)")
def reduced_form_cells(spark, sf_dir):
    """(I - rho W)^-1 under equal weights, cell by cell."""
    p = group_daily(spark, sf_dir)
    m = X.reduced_form(0.25, X.matrix(equal_field(p), roster_of(p)), np.eye(ITEMS))
    return rounded(spark.createDataFrame([(i, j, float(m[i, j])) for i in range(ITEMS) for j in range(ITEMS)], "i long, j long, value double"), "value")


@R.query("""
WITH e AS (SELECT target, candidate, 1.0 / count(*) OVER (PARTITION BY target) AS y FROM field WHERE weight > 0.1), b AS (SELECT target, candidate, weight AS x, coalesce(y, 0) AS y FROM field LEFT JOIN e USING (target, candidate)),
s AS (SELECT target, d, sum(b.x * gd.x) AS p, sum(b.y * gd.x) AS q FROM b JOIN gd ON candidate = t GROUP BY 1, 2), z AS (SELECT p, q FROM s JOIN gd ON target = t AND s.d = gd.d WHERE EXISTS (SELECT 1 FROM e JOIN gd h ON e.candidate = h.t WHERE e.target = s.target AND h.d = s.d)),
o AS (SELECT corr(x, y) AS weight_correlation, avg(abs(y - x)) AS mean_absolute_difference, sqrt(avg((y - x) ** 2)) AS rms_difference, count(*) FILTER (y > 1e-8) / count(*) AS support_jaccard FROM b)
SELECT [[weight_correlation]] AS weight_correlation, [[mean_absolute_difference]] AS mean_absolute_difference, [[rms_difference]] AS rms_difference, [[support_jaccard]] AS support_jaccard, [[corr(p, q)]] AS signal_correlation, [[stddev_samp(q - p)]] AS signal_difference_sd, [[stddev_samp(q)]] AS signal_sd, [[stddev_samp(q - p) / stddev_samp(q)]] AS relative_difference_sd FROM z, o GROUP BY weight_correlation, mean_absolute_difference, rms_difference, support_jaccard
""")
def operator_separation(spark, sf_dir):
    w = kept(rbf(spark, sf_dir), "field")
    s = C.separation(group_daily(spark, sf_dir), w, fields.equal_support_field(w, 0.1), factors=None)
    names = ("weight_correlation", "mean_absolute_difference", "rms_difference", "support_jaccard", "signal_correlation", "signal_difference_sd", "signal_sd", "relative_difference_sd")
    return rounded(s.select(*names), *names)


@R.query("SELECT CAST(count(DISTINCT t) AS INTEGER) AS assets, (SELECT round(rho, 4) FROM gr) AS rho, (SELECT round(rho / (1 - rho), 3) FROM gr) AS lambda FROM gd")
def universe_horizon_bridge(spark, sf_dir):
    """Cells of a small and a large universe over two horizons; the small one's long cell is reported here, the same as one fit."""
    p = kept(group_daily(spark, sf_dir), "panel")
    w = equal_field(p)
    last = p.agg(F.date_sub(F.max("Date"), 5).alias("d")).first()["d"]
    cells = C.bridge(p, p, w, w, last)
    assert C.bridge_contrasts(cells).count() == 2
    return cells.where("cell = 'small_long'").select("assets", F.round("rho", 4).alias("rho"), F.round("lambda", 3).alias("lambda"))


@R.query("SELECT i, [[CASE WHEN g < 0 THEN 0.0 WHEN g > 1 THEN 1.0 ELSE g END]] AS weight FROM (SELECT t.i, ((q.a - p.a) + (x.a - z.a)) / (2 * x.a - y.a - z.a) AS g FROM c3 t JOIN c3 x ON x.i = (t.i + 1) % 3 AND x.j = (t.i + 2) % 3 JOIN c3 y ON y.i = x.i AND y.j = x.i JOIN c3 z ON z.i = x.j AND z.j = x.j JOIN c3 p ON p.i = t.i AND p.j = x.i JOIN c3 q ON q.i = t.i AND q.j = x.j WHERE t.i = t.j)")
def energy_simplex_three(spark, sf_dir):
    """Three pooled items: each as a mixture of the other two, the weight of the next one."""
    return three(spark, sf_dir, "energy", "simplex")


@R.query("SELECT i, [[g]] AS weight FROM (SELECT t.i, ((p.k - q.k) - (x.k - z.k)) / (y.k + z.k - 2 * x.k) AS g FROM c3 t JOIN c3 x ON x.i = (t.i + 1) % 3 AND x.j = (t.i + 2) % 3 JOIN c3 y ON y.i = x.i AND y.j = x.i JOIN c3 z ON z.i = x.j AND z.j = x.j JOIN c3 p ON p.i = t.i AND p.j = x.i JOIN c3 q ON q.i = t.i AND q.j = x.j WHERE t.i = t.j)")
def mmd_affine_three(spark, sf_dir):
    return three(spark, sf_dir, "mmd", "affine")


def three(spark, sf_dir, kind: str, feasible: str) -> DataFrame:
    c = clouds(spark, sf_dir).withColumn("item", F.col("item") % 3)
    w = fields.target_projections(D.pair_means(c, "energy" if kind == "energy" else "linear"), kind, feasible)
    return rounded(w.where((F.col("target").cast("int") + 1) % 3 == F.col("candidate").cast("int")).select(F.col("target").cast("int").alias("i"), "weight"), "weight")


@R.query("SELECT i AS item_i, j AS item_j, [[sqrt(min(two))]] AS value FROM m4 GROUP BY 1, 2")
def wasserstein_w2_of_four(spark, sf_dir):
    """Order-2 distance of the first four rows of each item, against all permutations."""
    return rounded(D.wasserstein(clouds(spark, sf_dir), 2, 4), "value")


@R.query("SELECT i AS item_i, j AS item_j, [[min(one)]] AS value FROM m4 GROUP BY 1, 2")
def wasserstein_w1_of_four(spark, sf_dir):
    return rounded(D.wasserstein(clouds(spark, sf_dir), 1, 4), "value")


@R.query("WITH b AS (SELECT i, j, arg_min([a, b, c, d], two) AS m FROM m4 GROUP BY 1, 2) SELECT i AS item_i, j AS item_j, CAST(k - 1 AS INTEGER) AS place, CAST(m[k] - 1 AS INTEGER) AS matched FROM b, range(1, 5) t(k) UNION ALL SELECT j, i, CAST(k - 1 AS INTEGER), CAST(list_position(m, k) - 1 AS INTEGER) FROM b, range(1, 5) t(k)")
def anchored_couplings_of_four(spark, sf_dir):
    """The matching of every ordered pair, each unordered one solved once and inverted."""
    c = fields.anchored_couplings(D.first_rows(clouds(spark, sf_dir), 4)).drop("gap")
    return c.select("item_i", "item_j", F.posexplode("coupling").alias("place", "matched"))


@R.query("WITH o AS (SELECT i, j, 4 * one AS one, 4 * two AS two, row_number() OVER (PARTITION BY i, j ORDER BY one) AS p, row_number() OVER (PARTITION BY i, j ORDER BY two) AS q FROM m4), g AS (SELECT i, j, sum(CASE p WHEN 1 THEN -one WHEN 2 THEN one END) AS first, sum(CASE q WHEN 1 THEN -two WHEN 2 THEN two END) AS second FROM o GROUP BY 1, 2) SELECT i AS item_i, j AS item_j, [[first]] AS first, [[second]] AS second FROM g UNION ALL SELECT j, i, [[first]], [[second]] FROM g")
def coupling_gaps_of_four(spark, sf_dir):
    """By how much the best matching beats every other, at both orders, for every ordered pair."""
    c = D.first_rows(clouds(spark, sf_dir), 4)
    one, two = (fields.anchored_couplings(c, k).select("item_i", "item_j", F.col("gap").alias(n)) for k, n in ((1, "first"), (2, "second")))
    return rounded(one.join(two, ["item_i", "item_j"]), "first", "second")


@R.query("""
WITH b AS (SELECT i, j, arg_min([a, b, c, d], two) AS two, min(two) AS d2, arg_min([a, b, c, d], one) AS one, min(one) AS d1 FROM m4 GROUP BY 1, 2), s AS (SELECT 'quarter' AS arm, i, j, two AS m, 0.25 AS w, 0.1875 * d2 AS objective FROM b UNION ALL SELECT 'half', i, j, two, 0.5, 0.25 * d2 FROM b UNION ALL SELECT 'first order', i, j, one, 0.5, 0.5 * d1 FROM b)
SELECT arm, i AS item_i, j AS item_j, CAST(x.p - 1 AS INTEGER) AS place, [[list_sum(list_transform(range(1, len(x.v) + 1), lambda k: k * (w * x.v[k] + (1 - w) * y.v[k])))]] AS point, [[objective]] AS objective FROM s JOIN r4 x ON x.item = i JOIN r4 y ON y.item = j AND y.p = m[x.p]
""")
def measure_barycentres_of_four(spark, sf_dir):
    """Barycentres of all pairs at two weights of order 2 and at equal weights of order 1; a point's coordinates are summed up by their places."""
    c, out = D.first_rows(clouds(spark, sf_dir), 4), None
    for arm, w, order in (("quarter", 0.25, 2), ("half", 0.5, 2), ("first order", 0.5, 1)):
        b = fields.measure_barycentres(c, w, order).select(F.lit(arm).alias("arm"), "item_i", "item_j", "objective", F.posexplode("points").alias("place", "v"))
        out = b if out is None else out.unionByName(b)
    point = F.aggregate(F.transform("v", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("arm", "item_i", "item_j", "place", point.alias("point"), "objective"), "point", "objective")


@R.query("WITH h AS (SELECT item || '/' || key % 2 AS item, v FROM u), m AS (SELECT a.item AS i, b.item AS j, avg(list_distance(a.v, b.v)) AS m FROM h a, h b GROUP BY 1, 2), e AS (SELECT x.i, x.j, 2 * x.m - y.m - z.m AS value FROM m x JOIN m y ON y.i = x.i AND y.j = x.i JOIN m z ON z.i = x.j AND z.j = x.j WHERE x.i < x.j) SELECT split_part(i, '/', 1) = split_part(j, '/', 1) AS same, [[min(value)]] AS low, [[max(value)]] AS high FROM e GROUP BY 1")
def split_halves(spark, sf_dir):
    """Energy distance of the two halves of each item beside that between items."""
    c = clouds(spark, sf_dir).withColumn("item", F.concat_ws("/", F.col("item").cast("string"), (F.col("key") % 2).cast("string")))
    d = D.energy(c).where("item_i < item_j").withColumn("same", F.split("item_i", "/")[0] == F.split("item_j", "/")[0])
    return rounded(d.groupBy("same").agg(F.min("value").alias("low"), F.max("value").alias("high")), "low", "high")


@R.query("SELECT c_custkey, [[abs(c_acctbal / 7e3 - 0.5) + abs(c_nationkey / 25.0 - 0.1) + abs(0.25 - c_acctbal / 14e3)]] AS value FROM customer")
def axis_transport(spark, sf_dir):
    """Cents over sevens: no value lies half way between two of six decimals."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 7e3, F.col("c_nationkey") / 25.0, F.lit(0.25)).alias("p"), F.array(F.lit(0.5), F.lit(0.1), F.col("c_acctbal") / 14e3).alias("q"))
    return rounded(c.select("c_custkey", D.axis_w2("p", "q").alias("value")), "value")


@R.query("SELECT target, candidate, [[weight]] AS weight FROM field QUALIFY row_number() OVER (PARTITION BY target ORDER BY weight DESC, candidate) <= target % 4 + 1")
def top_support_sizes(spark, sf_dir):
    w = rbf(spark, sf_dir)
    sizes = w.select("target").distinct().withColumn("size", F.col("target") % 4 + 1)
    return rounded(fields.top_support(w, sizes), "weight")


@R.query("SELECT n_nationkey % 7 AS credit, n_regionkey AS scale, n_nationkey AS slack FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 ORDER BY credit DESC, scale, slack LIMIT 1")
def certificate_cell(spark, sf_dir):
    c = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 7).alias("credit"), F.col("n_regionkey").alias("scale"), F.col("n_nationkey").alias("slack"), (F.col("n_nationkey") % 5 != 0).alias("passes_confidence"), (F.col("n_nationkey") % 3 != 0).alias("passes_coverage"))
    return P.select_cell(c).select("credit", "scale", "slack")


@R.query("SELECT n_nationkey AS multiplier, n_nationkey % 7 AS score FROM nation ORDER BY score DESC, multiplier LIMIT 1")
def bandwidth_choice(spark, sf_dir):
    return fields.tune_bandwidth(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("multiplier"), (F.col("n_nationkey") % 7).alias("score")))


@R.query("SELECT item_i, item_j, [[greatest(w2 / 2 - 0.2, 0) ** 2]] AS value FROM dy")
def exposure_floors(spark, sf_dir):
    return rounded(P.exposure_floor(dyads(spark, sf_dir).select("item_i", "item_j", F.col("w2").alias("value")), 2.0, 0.1), "value")


@R.query("SELECT [[(corr(y, w2) - corr(y, level) * corr(w2, level)) ** 2 / ((1 - corr(y, level) ** 2) * (1 - corr(w2, level) ** 2))]] AS partial_r2 FROM dy")
def focal_partial_r2(spark, sf_dir):
    return rounded(spark.createDataFrame([(G.partial_r2(dyads(spark, sf_dir), "y", "w2", ["level"]),)], "partial_r2 double"), "partial_r2")


@R.query("SELECT 1 AS model, 'w2' AS term, [[regr_slope(y, w2)]] AS beta FROM dy UNION ALL SELECT 2, 'w2', [[(covar_pop(y, w2) * var_pop(level) - covar_pop(y, level) * covar_pop(w2, level)) / (var_pop(w2) * var_pop(level) - covar_pop(w2, level) ** 2)]] FROM dy UNION ALL SELECT 2, 'level', [[(covar_pop(y, level) * var_pop(w2) - covar_pop(y, w2) * covar_pop(w2, level)) / (var_pop(w2) * var_pop(level) - covar_pop(w2, level) ** 2)]] FROM dy")
def ladder_slopes(spark, sf_dir):
    """Slopes of the first two specifications of a ladder."""
    fits = G.model_ladder(dyads(spark, sf_dir), "y", (("w2",), ("w2", "level")))
    rows = [(f["model"], c, b) for f in fits[:2] for c, b in f["beta"].items() if c != "intercept"]
    return rounded(spark.createDataFrame(rows, "model int, term string, beta double"), "beta")


@R.query("""
WITH e AS (SELECT i AS k, x, y FROM d6 UNION ALL SELECT j, x, y FROM d6), s AS (SELECT k, sum(x) AS sx, sum(y) AS sy FROM e GROUP BY 1), t AS (SELECT sum(x) AS tx, sum(y) AS ty FROM d6), a AS (SELECT k, (sx - tx / 5) / 4 AS ax, (sy - ty / 5) / 4 AS ay FROM s, t),
r AS (SELECT d.x - p.ax - q.ax AS x, d.y - p.ay - q.ay AS y FROM d6 d JOIN a p ON p.k = i JOIN a q ON q.k = j) SELECT [[sum(x * y) / sum(x * x)]] AS beta, 6::BIGINT AS nodes FROM r
""")
def endpoint_effects(spark, sf_dir):
    """The slope between six groups with a symmetric effect for each endpoint."""
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 6).cast("int").alias("k")).agg(F.avg("value").alias("x"), (F.avg(F.col("value") * F.col("value")) / 100).alias("y"), F.count("*").alias("n"))
    d = g.toDF("item_i", "x1", "y1", "n1").join(g.toDF("item_j", "x2", "y2", "n2"), F.col("item_i") < F.col("item_j"))
    d = d.select("item_i", "item_j", F.abs(F.col("x1") - F.col("x2")).alias("x"), (F.abs(F.col("y1") - F.col("y2")) + F.col("n1") / 1e3 + F.col("n2") / 1e3).alias("y"))
    fit = G.dyadic_regression(d, "y", ["x"])
    return rounded(spark.createDataFrame([(fit["beta"]["x"], fit["nodes"])], "beta double, nodes long"), "beta")


@R.query("SELECT n_regionkey AS region, [[0.05 ** (1.0 / count(*))]] AS share_lower, [[CASE WHEN count(*) = 5 THEN avg(n_nationkey) - 2 * sqrt(cos(acos(sqrt(0.19)) / 3) / sqrt(0.19) - 1) * stddev_samp(n_nationkey) / sqrt(5) END]] AS mean_lower FROM nation GROUP BY 1")
def one_sided_bounds(spark, sf_dir):
    """Exact lower bounds by region: of a share with all successes, and of a mean of five, whose quantile has a closed form."""
    x = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.avg("n_nationkey").alias("mean"), F.stddev_samp("n_nationkey").alias("sd"))

    def bounds(batches):
        for pdf in batches:
            share = [G.clopper_pearson_lower(int(n), int(n), 0.95) for n in pdf["n"]]
            yield pdf.assign(share_lower=share, mean_lower=[G.mean_lower_bound(int(n), m, s, 0.95) for n, m, s in zip(pdf["n"], pdf["mean"], pdf["sd"], strict=True)])[["region", "share_lower", "mean_lower"]]

    return rounded(x.mapInPandas(bounds, f"region {x.schema['region'].dataType.simpleString()}, share_lower double, mean_lower double"), "share_lower", "mean_lower")


@R.query("WITH d AS (SELECT n_nationkey AS draw_id, c_mktsegment AS cell_id, avg(c_acctbal) AS value, count(*) % 4 <> 0 AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT a.draw_id, [[a.value - b.value]] AS difference FROM d a JOIN d b USING (draw_id) WHERE a.cell_id = 'BUILDING' AND b.cell_id = 'MACHINERY' AND a.ok AND b.ok")
def paired_contrast_draws(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("draw_id"), F.col("c_mktsegment").alias("cell_id")).agg(F.avg("c_acctbal").alias("value"), (F.count("*") % 4 != 0).alias("solve_ok"))
    return rounded(G.paired_contrast(c, "BUILDING", "MACHINERY"), "difference")


@R.query("WITH s AS (SELECT stratum, estimate AS x FROM rep WHERE estimate IS NOT NULL), m AS (SELECT stratum, avg(x) AS m FROM s GROUP BY 1) SELECT stratum, count(*) AS n, [[avg((x - m) ** 3) / sqrt(avg((x - m) ** 2)) ** 3]] AS skewness FROM s JOIN m USING (stratum) GROUP BY 1 UNION ALL SELECT 'constant', (SELECT count(*) FROM nation), NULL")
def sample_skewness(spark, sf_dir):
    """Population skewness of finite draws; none for a constant sample."""
    d = replications(spark, sf_dir).select("stratum", "estimate").unionByName(table(spark, sf_dir, "nation").select(F.lit("constant").alias("stratum"), F.lit(0.37).alias("estimate")))
    return rounded(C.skewness(d, "estimate", ["stratum"]), "skewness")


@R.query("SELECT event_type, count(*) AS count, [[avg(value)]] AS mean, [[var_pop(value) * count(*)]] AS m2, [[min(value)]] AS low, [[max(value)]] AS high FROM events GROUP BY 1")
def merged_moments(spark, sf_dir):
    """Moments of each type from the accumulators of its days."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return rounded(C.merged_moments(C.accumulated(e, "value", ["event_type", "day"]), ["event_type"]), "mean", "m2", "low", "high")


@R.query("WITH s AS (SELECT *, greatest(value, 0) AS x FROM (SELECT CAST(n_nationkey AS INTEGER) AS axis, 20.0 - n_nationkey AS value FROM nation)) SELECT axis, [[sum(x) OVER (ORDER BY axis) / sum(x) OVER ()]] AS cumulative FROM s")
def cumulative_shares(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("axis"), (20.0 - F.col("n_nationkey")).alias("eigenvalue"))
    return rounded(G.inertia(n).select("axis", "cumulative"), "cumulative")


@R.query("WITH s AS (SELECT item_i AS i, item_j AS j, greatest(value, 0) AS q FROM nrg), r AS (SELECT i, avg(q) AS m FROM s GROUP BY 1), b AS (SELECT s.i, s.j, -0.5 * (q - x.m - y.m + (SELECT avg(q) FROM s)) AS b FROM s JOIN r x ON x.i = s.i JOIN r y ON y.i = s.j) SELECT [[sum(b) FILTER (i = j)]] AS trace, [[sum(b * b)]] AS squares FROM b")
def pcoa_invariants(spark, sf_dir):
    """Sum and sum of squares of the principal coordinates' spectrum, which are those of the doubly centred matrix."""
    values, _ = O.principal_axes(D.energy_metric(D.energy(clouds(spark, sf_dir))), ITEMS)
    return rounded(spark.createDataFrame([(float(values.sum()), float((values * values).sum()))], "trace double, squares double"), "trace", "squares")


@R.query("SELECT item_i, item_j, [[sqrt(greatest(value, 0))]] AS value FROM nrg WHERE item_i <> item_j")
def matrix_round_trip(spark, sf_dir):
    """Pairs to a matrix and back."""
    names, m = G.matrix_of(D.energy_metric(D.energy(clouds(spark, sf_dir))))
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    return rounded(spark.createDataFrame(rows, "item_i int, item_j int, value double"), "value")


@R.query("WITH p AS (SELECT a.value AS x, c.k AS y FROM (SELECT item_i, item_j, value FROM nrg WHERE item_i < item_j) a JOIN (SELECT c.item_i, c.item_j, a.mean + b.mean - 2 * c.mean AS k FROM lin c JOIN lin a ON a.item_i = c.item_i AND a.item_j = c.item_i JOIN lin b ON b.item_i = c.item_j AND b.item_j = c.item_j) c USING (item_i, item_j)) SELECT [[corr(x, y)]] AS statistic, 999::BIGINT AS draws FROM p")
def mantel_statistic(spark, sf_dir):
    c = clouds(spark, sf_dir)
    r = G.mantel(D.energy(c), D.mmd(c, "linear"), "pearson", draws=999)
    return rounded(spark.createDataFrame([(r["statistic"], r["draws"])], "statistic double, draws long"), "statistic")


@R.query("WITH p AS (SELECT greatest(value, 0) AS q, item_i % 3 AS a, item_j % 3 AS b FROM nrg WHERE item_i < item_j), n AS (SELECT item % 3 AS g, count(DISTINCT item) AS n FROM u GROUP BY 1), t AS (SELECT sum(q) / (SELECT count(DISTINCT item) FROM u) AS t FROM p), w AS (SELECT sum(s / n) AS w FROM (SELECT a AS g, sum(q) AS s FROM p WHERE a = b GROUP BY 1) JOIN n USING (g)) SELECT [[(t - w) / t]] AS r2, [[(t - w) / 2 / (w / ((SELECT count(DISTINCT item) FROM u) - 3))]] AS pseudo_f FROM t, w")
def permanova_statistic(spark, sf_dir):
    e = D.energy_metric(D.energy(clouds(spark, sf_dir)))
    labels = e.select(F.col("item_i").alias("item")).distinct().withColumn("label", F.col("item") % 3)
    r = G.permanova(e, labels, draws=99)
    return rounded(spark.createDataFrame([(r["r2"], r["pseudo_f"])], "r2 double, pseudo_f double"), "r2", "pseudo_f")


@R.query("WITH a AS (SELECT \"Date\", sum(x) FILTER (ticker = 'view') AS p, sum(x) FILTER (ticker <> 'view') AS q FROM (SELECT event_type AS ticker, CAST(ts AS DATE) AS \"Date\", sum(value) AS x FROM events GROUP BY 1, 2) GROUP BY 1), v AS (SELECT var_samp(p) AS p, var_samp(q) AS q, covar_samp(p, q) AS c FROM a WHERE p IS NOT NULL AND q IS NOT NULL) SELECT [[greatest(0, least(1, (q - c) / (p + q - 2 * c)))]] AS weight FROM v")
def minimum_variance_two(spark, sf_dir):
    """The long-only weight of one of two assets."""
    p = daily(spark, sf_dir).groupBy("Date", F.when(F.col("ticker") == "view", "a").otherwise("b").alias("ticker")).agg(F.sum("return").alias("return"))
    c = {(r["ticker_i"], r["ticker_j"]): r["covariance"] for r in panels.covariance_long(panels.complete_case(p)).collect()}
    w, _ = P.minimum_variance(np.array([[c["a", "a"], c["a", "b"]], [c["a", "b"], c["b", "b"]]]))
    return rounded(spark.createDataFrame([(float(w[0]),)], "weight double"), "weight")


@R.query("WITH a AS (SELECT \"Date\", sum(x) FILTER (ticker = 'view') AS p, sum(x) FILTER (ticker <> 'view') AS q FROM (SELECT event_type AS ticker, CAST(ts AS DATE) AS \"Date\", sum(value) AS x FROM events GROUP BY 1, 2) GROUP BY 1) SELECT [[var_pop(p)]] AS a, [[covar_pop(p, q)]] AS c, [[var_pop(q)]] AS b FROM a WHERE p IS NOT NULL AND q IS NOT NULL")
def ledoit_wolf_two(spark, sf_dir):
    """Shrinkage to constant correlation leaves the covariance of two series as it is."""
    p = daily(spark, sf_dir).groupBy("Date", F.when(F.col("ticker") == "view", "a").otherwise("b").alias("ticker")).agg(F.sum("return").alias("return"))
    (x,) = C.grid_of(panels.complete_case(p), ["a", "b"], ["return"])
    s, _ = X.ledoit_wolf(x)
    return rounded(spark.createDataFrame([(float(s[0, 0]), float(s[0, 1]), float(s[1, 1]))], "a double, c double, b double"), "a", "c", "b")


@R.query("SELECT [[sum(n_nationkey * (n_regionkey + 1.0)) / sum((n_regionkey + 1.0) ** 2)]] AS slope FROM nation")
def gmm_common_slope(spark, sf_dir):
    """The common slope of two vectors by moments with the identity weight, with its influence values' standard error computed beside it."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    q, d = np.array([float(r["n_nationkey"]) for r in rows]), np.array([r["n_regionkey"] + 1.0 for r in rows])
    b, _ = G.linear_gmm(q, d[:, None], np.eye(len(q)))
    _, se = G.gmm_influence(q, d, np.eye(len(q)), np.eye(len(q)), np.eye(len(q)))
    assert math.isfinite(se)
    return rounded(spark.createDataFrame([(float(b[0]),)], "slope double"), "slope")


@R.query("SELECT n_nationkey, [[greatest((n_regionkey - 1.5) / (n_nationkey + 1), 0)]] AS x FROM nation")
def orthant_solutions(spark, sf_dir):
    """A separable variational inequality on the orthant, a coordinate for each nation."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    a, b = np.array([r["n_nationkey"] + 1.0 for r in rows]), np.array([r["n_regionkey"] - 1.5 for r in rows])
    x, _ = S.solve_orthant(lambda z: a * z - b, np.zeros(len(a)), 1.0, 1e-9)
    return rounded(spark.createDataFrame([(r["n_nationkey"], float(v)) for r, v in zip(rows, x, strict=True)], "n_nationkey int, x double"), "x")


@R.query("SELECT n_regionkey AS firm, n_nationkey AS atom, CAST(s AS INTEGER) AS sign, [[CASE WHEN n_regionkey > 0 THEN n_regionkey * (n_nationkey + 1) / (2.0 * sum(n_regionkey * (n_nationkey + 1)) OVER (PARTITION BY n_regionkey, s)) END]] AS mass FROM nation, (VALUES (1), (-1)) t(s)")
def reported_laws(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("firm"), F.col("n_nationkey").alias("activity"), F.col("n_regionkey").cast("double").alias("intensity"), (F.col("n_nationkey") + 1.0).alias("share"))
    return rounded(S.reported_law(n), "mass")


@R.query("WITH h AS (SELECT c_custkey AS market, h, d, CASE WHEN (h >> (3 - d)) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * c_acctbal / 1e3 AS s FROM customer, range(16) a(h), range(4) b(d)) SELECT market, CAST(h AS INTEGER) AS history, CAST(d AS INTEGER) AS date, [[s]] AS news, [[sum(s) OVER (PARTITION BY market, h ORDER BY d)]] AS level FROM h")
def news_histories(spark, sf_dir):
    """Every history of four dates of news, of the size of each customer's balance."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("market"), (F.col("c_acctbal") / 1e3).alias("size"))
    return rounded(S.histories(c), "news", "level")


@R.query("""
WITH c AS (SELECT n_regionkey AS economy, n_nationkey AS firm, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), l AS (SELECT economy, firm, 1 + 0.2 * n / max(n) OVER (PARTITION BY economy) AS l, count(*) OVER (PARTITION BY economy) AS f FROM c),
a AS (SELECT *, (l - 0.3 * sum(l) OVER (PARTITION BY economy) / (1.5 + 0.3 * f)) / 1.5 AS q FROM l), b AS (SELECT *, (l + 0.5 * q - 0.3 * (sum(l + 0.5 * q) OVER (PARTITION BY economy)) / (1.5 + 0.3 * f)) / 1.5 AS z FROM a), t AS (SELECT *, sum(z) OVER (PARTITION BY economy) AS s FROM b)
SELECT economy, firm, [[z]] AS intensity, [[z + (l - z - 0.3 * s - 0.3 * z * f) / (1.5 + 0.3 * f)]] AS response, true AS staged, true AS solved FROM t
""")
def economy_contracts(spark, sf_dir):
    """Regions as economies of one activity, nations as firms: two moves and the response after them, in closed form where all are active."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    size = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("economy"), F.col("n_nationkey").alias("firm")).agg(F.count("*").alias("n"))
    most = size.groupBy("economy").agg(F.max("n").alias("most"))
    levels = size.join(most, "economy").select("economy", "firm", F.lit(0).alias("activity"), (1 + 0.2 * F.col("n") / F.col("most")).alias("level"))
    return rounded(S.responses(levels, 2).withColumn("solved", F.col("residual") < 1e-9).drop("residual"), "intensity", "response")


@R.query("WITH n AS (SELECT count(DISTINCT t) AS n FROM gd) SELECT [[1.0 / (n - 1)]] AS dobrushin, [[1.0 / n]] AS stationary_max, [[(n - 2) / ((n - 1.0) ** 2)]] AS two_step_min, [[1 / (1 - 0.4)]] AS resolvent_bound FROM n")
def network_certificate_equal(spark, sf_dir):
    p = group_daily(spark, sf_dir)
    c = fields.network_certificate(X.matrix(equal_field(p), roster_of(p)), 0.4)
    names = ("dobrushin", "stationary_max", "two_step_min", "resolvent_bound")
    return rounded(spark.createDataFrame([tuple(float(c[k]) for k in names)], ", ".join(f"{k} double" for k in names)), *names)
