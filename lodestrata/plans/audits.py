"""Queries over diagnostics: variances by asset, projections of triples, draws of dates and nodes, shrinkage, compared with SQL where it is closed.

The second field of the two-field fits pairs neighbours (0 with 1, 2 with 3, ...). It commutes with equal weights, so SQL knows the
eigenvalues of their mixtures: 1 once, (1 - theta) - theta / 9 four times and -(1 - theta) - theta / 9 five times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import comparisons as C
from lodestrata.operators import distances as D
from lodestrata.operators import moments as M
from lodestrata.operators import ordination as O  # noqa: E741
from lodestrata.operators import panels
from lodestrata.operators import regression as G
from lodestrata.operators import resampling as B
from lodestrata.operators import spatial as X
from lodestrata.operators.ordered import running_totals
from lodestrata.plans.clouds import clouds, group_daily
from lodestrata.plans.fits import R as FITS
from lodestrata.plans.fits import centred_groups, equal_field, factor_panel, roster_of
from lodestrata.plans.inference import dyads
from lodestrata.plans.register import Registry, fresh, rounded
from lodestrata.sources import archives
from lodestrata.sources.tables import table

THETAS, RHOS, MOST = 21, 100, 0.99


def own_likelihood(rho: str) -> str:
    """Log-likelihood with a variance for each asset, over the rows of ga."""
    return f"sum(-0.5 * ga.n * (ln(2 * pi() * (ga.rr - 2 * ({rho}) * ga.rw + ({rho}) * ({rho}) * ga.ww) / ga.n) + 1)) + (SELECT count(DISTINCT d) FROM gs) * (ln(1 - ({rho})) + 9 * ln(1 + ({rho}) / 9))"


R = Registry(
    **FITS.common,
    ga="SELECT t, count(*) AS n, sum(x * x) AS rr, sum(x * w) AS rw, sum(w * w) AS ww FROM gs GROUP BY 1",
    gb=f"SELECT arg_max(r, l) AS r FROM (SELECT k / 1e3 AS r, {own_likelihood('k / 1e3')} AS l FROM range(-998, 999) g(k), ga GROUP BY k)",
    gh=f"SELECT arg_max(r, l) AS rho, max(l) AS loglik FROM (SELECT gb.r + k / 1e6 AS r, {own_likelihood('gb.r + k / 1e6')} AS l FROM gb, range(-1000, 1001) g(k), ga GROUP BY gb.r, k)",
    gfull="SELECT t, d, x - avg(x) OVER (PARTITION BY t) AS x FROM gd WHERE d IN (SELECT d FROM gd GROUP BY 1 HAVING count(*) = 10)",
    cl="SELECT CAST(day(ts) % 3 AS INTEGER) AS year, CAST(event_id % 7 AS INTEGER) AS target, CAST((event_id // 7) % 7 AS INTEGER) AS reference, avg(value) AS distance, sum(length(props)) / 100.0 AS financial FROM events GROUP BY 1, 2, 3",
    off="SELECT * FROM cl WHERE target <> reference",
    tri="SELECT a.year, a.target AS t, a.reference AS j, b.reference AS k, (a.financial - b.financial) * (a.distance - b.distance) / 3 AS q, (a.distance - b.distance) ** 2 / 3 AS e FROM off a JOIN off b ON a.year = b.year AND a.target = b.target AND a.reference < b.reference",
    yr="SELECT year, count(DISTINCT target) AS n FROM off GROUP BY 1",
    tot="SELECT year, n, sum(q) / (n * (n - 1) * (n - 2) / 6) AS uq, sum(e) / (n * (n - 1) * (n - 2) / 6) AS ue FROM tri JOIN yr USING (year) GROUP BY 1, 2",
    inc="SELECT year, f AS firm, sum(q) AS q, sum(e) AS e FROM (SELECT year, unnest([t, j, k]) AS f, q, e FROM tri) GROUP BY 1, 2",
    fp="SELECT year, firm, n, 3 * (n - 2) / (2 * (n - 1)) * (inc.q / ((n - 1) * (n - 2) / 2) - uq) AS numerator, 3 * (n - 2) / (2 * (n - 1)) * (inc.e / ((n - 1) * (n - 2) / 2) - ue) AS denominator FROM inc JOIN tot USING (year)",
)
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.query("SELECT round(rho, 4) AS rho, round(loglik, 2) AS loglik, (SELECT sum(n) FROM ga)::BIGINT AS n FROM gh")
def sar_factor_diagonal(spark, sf_dir):
    """Spatial autoregression with factors and an innovation variance for each asset."""
    p = factor_panel(spark, sf_dir)
    fit, _ = X.sar_factor_qmle(p, equal_field(p), ["MKT"], roster_of(p), variance="diagonal")
    return spark.createDataFrame([(round(fit.rho, 4), round(fit.loglik, 2), fit.n)], "rho double, loglik double, n long")


@R.query('SELECT d AS "Date", [[ln(1 - 0.3) + 9 * ln(1 + 0.3 / 9) - 0.5 * sum(ln(2 * pi() * (300 + 20 * t)) + (x - 0.3 * w) ** 2 / (300 + 20 * t))]] AS score FROM gs GROUP BY 1', text=("Date",))
def factor_diagonal_scores(spark, sf_dir):
    """Daily log densities at given intensity and variances, with the loadings of the same panel."""
    p = factor_panel(spark, sf_dir)
    w, roster = equal_field(p), roster_of(p)
    lag = X.spatial_lag(p, w, "excess").withColumnRenamed("target", "ticker")
    both = p.join(lag, ["ticker", "Date"])
    (_, own), (_, lagged) = X.factor_residuals(both, ["MKT"], "excess"), X.factor_residuals(both, ["MKT"], "lag")
    at = own.join(lagged.withColumnRenamed("coefficients", "l"), "ticker").select("ticker", F.zip_with("coefficients", "l", lambda a, b: a - 0.3 * b).alias("coefficients"))
    fit = X.SpatialFit(0.3, 0.0, 400.0, 1, 1, variances=np.array([300.0 + 20 * t for t in roster]))
    return rounded(X.factor_log_scores(p, w, ["MKT"], roster, fit, at, "excess"), "score")


@R.query(f"SELECT 'equal' AS operator, round(2 * (gh.loglik - (SELECT {own_likelihood('0')} FROM ga)), 2) AS qlr, round(gh.rho, 4) AS rho FROM gh WHERE (SELECT count(*) FROM gd) = 10 * (SELECT count(DISTINCT d) FROM gd) UNION ALL SELECT 'gaps', NULL, NULL WHERE (SELECT count(*) FROM gd) < 10 * (SELECT count(DISTINCT d) FROM gd)")
def spatial_value_diagonal(spark, sf_dir):
    """The likelihood ratio of a spatial fit over factors alone, each asset with its own variance; a panel with gaps is refused."""
    p = factor_panel(spark, sf_dir)
    roster = roster_of(p)
    try:
        r, f = C.grid_of(p, roster, ["excess", "MKT"])
    except ValueError:
        return spark.createDataFrame([("gaps", None, None)], "operator string, qlr double, rho double")
    summary, _ = C.spatial_value(spark, r, f[:, :1], {"equal": X.matrix(equal_field(p), roster)}, 19, 5, 3, diagonal=True)
    return summary.select("operator", F.round("qlr", 2).alias("qlr"), F.round("rho", 4).alias("rho"))


def neighbour_field(panel: DataFrame) -> DataFrame:
    """Each asset with the one it is paired with."""
    return panel.select(F.col("ticker").alias("target")).distinct().select("target", F.expr("cast(target ^ 1 as int)").alias("candidate"), F.lit(1.0).alias("weight"))


def two_fields(spark, sf_dir) -> tuple[DataFrame, X.TwoFieldGrid]:
    p = group_daily(spark, sf_dir)
    one, two, roster = equal_field(p), neighbour_field(p), roster_of(p)
    return X.two_field_gram(p, one, two), X.TwoFieldGrid.of(X.matrix(one, roster), X.matrix(two, roster), THETAS, RHOS, MOST)


@R.query(f"""
WITH z AS (SELECT t, d, x, (sum(x) OVER (PARTITION BY d) - x) / 9.0 AS a FROM gd), y AS (SELECT z.x, z.a, o.x AS b, z.d FROM z JOIN gd o ON o.t = xor(z.t, 1) AND o.d = z.d QUALIFY count(*) OVER (PARTITION BY z.d) > 0),
m AS (SELECT count(*) AS n, count(DISTINCT d) AS t, sum(x) AS s1, sum(a) AS s2, sum(b) AS s3, sum(x * x) AS g11, sum(x * a) AS g12, sum(x * b) AS g13, sum(a * a) AS g22, sum(a * b) AS g23, sum(b * b) AS g33 FROM y),
c AS (SELECT n, t, g11 - s1 * s1 / n AS g11, g12 - s1 * s2 / n AS g12, g13 - s1 * s3 / n AS g13, g22 - s2 * s2 / n AS g22, g23 - s2 * s3 / n AS g23, g33 - s3 * s3 / n AS g33 FROM m),
g AS (SELECT i / {THETAS - 1}.0 AS theta, k * {MOST} / {RHOS - 1} AS rho FROM range({THETAS}) a(i), range({RHOS}) b(k)),
l AS (SELECT theta, rho, -0.5 * n * (ln(2 * pi() * (g11 - 2 * rho * (theta * g12 + (1 - theta) * g13) + rho * rho * (theta * theta * g22 + 2 * theta * (1 - theta) * g23 + (1 - theta) * (1 - theta) * g33)) / n) + 1)
  + t * (ln(1 - rho) + 4 * ln(1 - rho * (1 - theta - theta / 9)) + 5 * ln(1 + rho * (1 - theta + theta / 9))) AS loglik FROM g, c)
SELECT [[theta]] AS theta, [[rho]] AS rho, [[theta * rho]] AS rho_1, [[(1 - theta) * rho]] AS rho_2, round(loglik, 3) AS loglik FROM l ORDER BY l.loglik DESC LIMIT 1
""")
def two_field_grid_point(spark, sf_dir):
    """The best grid point of the two-field profile with a common intercept, and both channels' intensities."""
    gram, grid = two_fields(spark, sf_dir)
    m = gram.agg(F.count(F.lit(1)).alias("dates"), *(F.sum(c).alias(c) for c in X.GRAM)).first().asDict()
    fit = X.two_field_point(m, grid, refine=False)
    out = spark.createDataFrame([tuple(fit[k] for k in ("theta", "rho", "rho_1", "rho_2", "loglik"))], "theta double, rho double, rho_1 double, rho_2 double, loglik double")
    return rounded(out, "theta", "rho", "rho_1", "rho_2").withColumn("loglik", F.round("loglik", 3))


@R.query()
def two_field_intervals(spark, sf_dir):
    """Intervals of both channels over two thousand joint draws of dates, each polished inside its cell."""
    gram, grid = two_fields(spark, sf_dir)
    draws = X.two_field_refits(gram, grid, 2000, 21, 5)
    return rounded(X.refit_intervals(draws), "rho_1_low", "rho_1_high", "rho_2_low", "rho_2_high", "theta_low", "theta_high")


def whole_cells(spark, sf_dir) -> DataFrame:
    """(year, target, reference, distance, financial), every pair of seven firms in each of three classes of days."""
    e = table(spark, sf_dir, "events")
    at = [(F.dayofmonth("ts") % 3).cast("int").alias("year"), (F.col("event_id") % 7).cast("int").alias("target"), (F.floor(F.col("event_id") / 7) % 7).cast("int").alias("reference")]
    return e.groupBy(*at).agg(F.avg("value").alias("distance"), (F.sum(F.length("props")) / 100.0).alias("financial"))


@R.query("SELECT year, firm, [[numerator]] AS numerator, [[denominator]] AS denominator, n FROM fp")
def firm_projections(spark, sf_dir):
    """First projections of the triple kernel, against all triples written out."""
    return rounded(M.firm_projections(whole_cells(spark, sf_dir)), "numerator", "denominator")


@R.query("""
WITH w AS (SELECT sum(q) AS q, sum(e) AS e FROM (SELECT year, (n - 2) / (2.0 * (n - 1)) * uq AS q, (n - 2) / (2.0 * (n - 1)) * ue AS e FROM tot)), i AS (SELECT firm, sum(numerator - w.q / w.e * denominator) / any_value(w.e) AS i FROM fp, w GROUP BY 1), s AS (SELECT count(*) AS firms, sqrt(var_samp(i) / count(*)) AS se FROM i)
SELECT [[q / e]] AS slope, [[q]] AS numerator, [[e]] AS denominator, [[se]] AS se, [[q / e - 1.6448536269514722 * se]] AS lower, firms, 'defined' AS status FROM w, s
""")
def projection_audit(spark, sf_dir):
    """The pooled slope with the standard error and the lower bound of its projections."""
    return rounded(M.projection_audit(whole_cells(spark, sf_dir)), "slope", "numerator", "denominator", "se", "lower")


@R.query("""
WITH f AS (SELECT regr_slope(y, w2) AS b, regr_intercept(y, w2) AS a, regr_avgx(y, w2) AS m, regr_sxx(y, w2) AS sxx, count(*) AS n, regr_syy(y, w2) * (1 - regr_r2(y, w2)) AS sse FROM dy),
z AS (SELECT item_i, item_j, (y - a - b * w2) ** 2 / (sse / (n - 2) * (1 - 1.0 / n - (w2 - m) ** 2 / sxx)) - 1 AS z FROM dy, f), c AS (SELECT item_i, item_j, z - (SELECT avg(z) FROM z) AS c FROM z),
p AS (SELECT a.c * b.c AS p, a.item_i IN (b.item_i, b.item_j) OR a.item_j IN (b.item_i, b.item_j) AS s FROM c a JOIN c b ON (a.item_i, a.item_j) < (b.item_i, b.item_j))
SELECT [[(avg(p) FILTER (s) - avg(p) FILTER (NOT s)) / (SELECT avg(c * c) FROM c)]] AS statistic, 999::BIGINT AS draws, true AS bounded FROM p
""")
def residual_scale(spark, sf_dir):
    """The statistic of squared studentised residuals at shared endpoints; its permutations give p, which SQL cannot repeat."""
    found, draws = G.residual_scale(dyads(spark, sf_dir), "y", ["w2"])
    out = spark.createDataFrame([(found["statistic"], draws.count(), 1 / 1000 <= found["p"] <= 1 and found["failure"] == (found["statistic"] > found["q95"]))], "statistic double, draws long, bounded boolean")
    return rounded(out, "statistic")


@R.query()
def endpoint_bootstrap(spark, sf_dir):
    """The slope with endpoint effects and its spread over two thousand draws of nodes."""
    d = dyads(spark, sf_dir)
    nodes = sorted(r[0] for r in d.select(F.explode(F.array("item_i", "item_j")).alias("n")).distinct().collect())
    estimate = G.dyadic_regression(d, "y", ["w2"])["beta"]["w2"]
    draws = G.endpoint_bootstrap(d, B.node_counts(spark, nodes, 2000, 42), "y", ["w2"])
    return rounded(G.bootstrap_summary(draws, estimate), "estimate", "se", "low", "high", "p", "t")


@R.query("""
WITH e AS (SELECT a.t AS i, b.t AS j, avg(a.x * b.x) AS s, avg(a.x ** 2 * b.x ** 2) AS p, avg(a.x ** 3 * b.x) AS q, count(*) AS n FROM gfull a JOIN gfull b USING (d) GROUP BY 1, 2), o AS (SELECT e.*, x.s AS ii, y.s AS jj FROM e JOIN e x ON x.i = e.i AND x.j = e.i JOIN e y ON y.i = e.j AND y.j = e.j),
r AS (SELECT avg(s / sqrt(ii * jj)) AS r FROM o WHERE i <> j), k AS (SELECT sum(p - s * s) - sum(p - s * s) FILTER (i = j) - any_value(r) * sum(sqrt(jj / ii) * (q - ii * s)) FILTER (i <> j) AS a, sum((r * sqrt(ii * jj) - s) ** 2) FILTER (i <> j) AS g, any_value(n) AS n FROM o, r), h AS (SELECT greatest(0, least(1, a / g / n)) AS h FROM k)
SELECT i AS ticker_i, j AS ticker_j, [[CASE WHEN i = j THEN s ELSE h * r * sqrt(ii * jj) + (1 - h) * s END]] AS value, [[h]] AS intensity FROM o, r, h
""")
def shrunk_covariance(spark, sf_dir):
    """Ledoit-Wolf shrinkage to constant correlation from sums over dates by pair."""
    return rounded(X.shrunk_covariance(panels.complete_case(group_daily(spark, sf_dir))), "value", "intensity")


@R.query("""
WITH s AS (SELECT item_i AS i, item_j AS j, greatest(value, 0) AS q FROM nrg), r AS (SELECT i, avg(q) AS m FROM s GROUP BY 1), b AS (SELECT s.i, s.j, -0.5 * (q - x.m - y.m + (SELECT avg(q) FROM s)) AS b FROM s JOIN r x ON x.i = s.i JOIN r y ON y.i = s.j), z AS (SELECT i, j, b / (SELECT sum(abs(b)) FROM b WHERE i = j) AS b FROM b),
w2 AS (SELECT x.i, y.j, sum(x.b * y.b) * 20 AS b FROM z x JOIN z y ON x.j = y.i GROUP BY 1, 2), w4 AS (SELECT x.i, y.j, sum(x.b * y.b) * 20 AS b FROM w2 x JOIN w2 y ON x.j = y.i GROUP BY 1, 2), w8 AS (SELECT x.i, y.j, sum(x.b * y.b) * 20 AS b FROM w4 x JOIN w4 y ON x.j = y.i GROUP BY 1, 2), w16 AS (SELECT x.i, y.j, sum(x.b * y.b) * 20 AS b FROM w8 x JOIN w8 y ON x.j = y.i GROUP BY 1, 2),
v AS (SELECT i, sum(b * (1 + i * i / 7.0)) AS x FROM w16 GROUP BY 1), v2 AS (SELECT p.i, sum(b * x) AS x FROM w16 p JOIN v ON v.i = p.j GROUP BY 1), v3 AS (SELECT p.i, sum(b * x) AS x FROM w16 p JOIN v2 v ON v.i = p.j GROUP BY 1), v4 AS (SELECT p.i, sum(b * x) AS x FROM w16 p JOIN v3 v ON v.i = p.j GROUP BY 1), v5 AS (SELECT p.i, sum(b * x) AS x FROM w16 p JOIN v4 v ON v.i = p.j GROUP BY 1)
SELECT round((SELECT sum(b.b * x.x * y.x) FROM b JOIN v5 x ON x.i = b.i JOIN v5 y ON y.i = b.j) / (SELECT sum(x * x) FROM v5), 4) AS inertia
""")
def leading_inertia(spark, sf_dir):
    """The largest value of the principal coordinates' spectrum, against powers of the doubly centred matrix."""
    values, _ = O.principal_axes(D.energy_metric(D.energy(clouds(spark, sf_dir))), 2)
    return spark.createDataFrame([(round(float(max(values, key=abs)), 4),)], "inertia double")


@R.query("""
WITH m AS (SELECT item, avg(v[1]) AS a, avg(v[2]) AS b FROM u GROUP BY 1), w AS (SELECT n.item_i AS i, n.item_j AS j, sqrt(greatest(value, 0)) AS o, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS p FROM nrg n JOIN m x ON x.item = n.item_i JOIN m y ON y.item = n.item_j WHERE n.item_i <> n.item_j),
h AS (SELECT *, rank() OVER (ORDER BY o) AS ro, rank() OVER (ORDER BY p) AS rp FROM w WHERE i < j), q AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY o, j) AS a, row_number() OVER (PARTITION BY i ORDER BY p, j) AS b FROM w)
SELECT [[sqrt(sum((o - p) ** 2) / sum(o * o))]] AS stress, [[sqrt((sum(o * o) - sum(o * p) ** 2 / sum(p * p)) / sum(o * o))]] AS fitted_stress, [[sum(o * p) / sum(p * p)]] AS scale, [[corr(o, p)]] AS pearson, [[corr(ro, rp)]] AS spearman, (SELECT [[count(*) FILTER (a <= 3 AND b <= 3) / 3.0 / (SELECT count(*) FROM m)]] FROM q) AS recall, (SELECT count(*) FILTER (a = 1 AND b = 1) FROM q) AS same_nearest FROM h
""")
def map_fidelity(spark, sf_dir):
    """How well the first two coordinates of the items' means keep their energy distances."""
    c = clouds(spark, sf_dir)
    means = c.groupBy("item").agg(F.array(F.avg(F.col("v")[0]), F.avg(F.col("v")[1])).alias("x"))
    return rounded(O.fidelity(D.energy_metric(D.energy(c)), means, 3), "stress", "fitted_stress", "scale", "pearson", "spearman", "recall")


@R.query()
def metric_scaling_fidelity(spark, sf_dir):
    """The best of a hundred starts of metric scaling in the plane, with the fidelity of its map."""
    e = D.energy_metric(D.energy(clouds(spark, sf_dir)))
    x, _ = O.metric_scaling(e)
    return rounded(O.fidelity(e, x), "stress", "fitted_stress", "scale", "pearson", "spearman", "recall")


@R.query()
def dispersion_test(spark, sf_dir):
    """Whether three classes of items spread alike, by 9,999 permutations."""
    e = D.energy_metric(D.energy(clouds(spark, sf_dir)))
    labels = e.select(F.col("item_i").alias("item")).distinct().withColumn("label", F.col("item") % 3)
    return rounded(O.dispersion_test(e, labels), "f", "p")


def source_archives(spark, sf_dir) -> str:
    """A folder of npz archives, one for each source: documents as rows, letters a to z as columns, counts as values."""
    folder, letters = fresh(spark, "npz"), "abcdefghijklmnopqrstuvwxyz"
    t = F.lower(F.coalesce("text", F.lit("")))
    counts = F.array(*((F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))).cast("double") for x in letters))
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.filter(F.transform(counts, lambda v, i: F.struct(i.alias("c"), v.alias("v"))), lambda s: s["v"] > 0).alias("e"))
    numbered = running_totals(d, ["source"], [F.col("doc_id")], {"row": F.lit(1)}).select("source", "row", F.transform("e", lambda s: s["c"]).alias("columns"), F.transform("e", lambda s: s["v"]).alias("values"))
    archives.write_npz_sparse(numbered, folder, "source", len(letters)).count()
    return folder


@R.query("""
WITH l AS (SELECT source || '.npz' AS name, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT name, row, k, length(t) - length(replace(t, chr(CAST(97 + k AS INTEGER)), '')) AS n FROM l, range(26) r(k))
SELECT name, CAST(k AS INTEGER) AS letter, count(*) FILTER (n > 0) AS rows, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n * (row + 1)) AS DOUBLE) AS moment FROM c WHERE n > 0 GROUP BY 1, 2
""")
def npz_letters(spark, sf_dir):
    """Counts of letters by source, from archives of sparse matrices that were written and read by tasks."""
    rows = archives.npz_sparse_rows(spark, source_archives(spark, sf_dir))
    each = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "row", F.explode(F.arrays_zip("columns", "values")).alias("e"))
    v = F.col("e.values")
    return each.groupBy("name", F.col("e.columns").alias("letter")).agg(F.count("*").alias("rows"), F.sum(v).alias("total"), F.sum(v * (F.col("row") + 1)).alias("moment"))


@R.query("""
WITH l AS (SELECT source || '.npz' AS name, doc_id, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT name, doc_id, length(t) - length(replace(t, chr(CAST(97 + k AS INTEGER)), '')) AS n FROM l, range(26) r(k)), n AS (SELECT name, count(DISTINCT doc_id) AS docs, count(*) FILTER (n > 0) AS entries, CAST(sum(n) AS DOUBLE) AS total FROM c GROUP BY 1)
SELECT name, 'data' AS member, entries AS numbers, total FROM n UNION ALL SELECT name, 'indptr', docs + 1, NULL FROM n UNION ALL SELECT name, 'indices', entries, NULL FROM n UNION ALL SELECT name, 'shape', 2, docs + 26.0 FROM n
""")
def npz_members(spark, sf_dir):
    """Every member of the archives, by its numbers, and their sum for data and shape."""
    m = archives.npz_members(spark, source_archives(spark, sf_dir))
    whole = m.groupBy(F.element_at(F.split("path", "/"), -1).alias("name"), "member").agg(F.sum(F.size("values")).alias("numbers"), F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))
    return whole.withColumn("total", F.when(F.col("member").isin("data", "shape"), F.col("total")))
