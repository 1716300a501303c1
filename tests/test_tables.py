"""Readers, contracts, sinks, joins and panels on small tables."""

import dataclasses
import datetime as dt
import hashlib
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import distances, moments, pairs, panels, portfolios, regression, resampling, spatial
from lodestrata.sources import contracts, documents, factors, sinks, tables
from lodestrata.sources.contracts import ContractError
from lodestrata.streaming import windows

D = dt.date


def test_contracts(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 0.0), ("b", "b", 0.0)], "item_i string, item_j string, value double")
    assert contracts.square(df) is df
    with pytest.raises(ContractError):
        contracts.square(df.where("item_i <> 'b' or item_j <> 'a'"))
    with pytest.raises(ContractError):
        contracts.square(df.withColumn("value", F.when(F.col("item_i") < F.col("item_j"), 2.0).otherwise(F.col("value"))))
    with pytest.raises(ContractError):
        contracts.unique_pair(df, "item_i", "item_j")
    with pytest.raises(ContractError):
        contracts.unique(df.unionByName(df), "item_i", "item_j")
    w = df.where("item_i <> item_j").toDF("target", "candidate", "weight")
    contracts.row_stochastic(w)
    with pytest.raises(ContractError):
        contracts.row_stochastic(w.withColumn("weight", F.lit(0.5)))
    contracts.same_rows(df, df.orderBy(F.desc("item_i")), ["item_i", "item_j"])
    with pytest.raises(ContractError):
        contracts.same_rows(df, df.withColumn("value", F.col("value") + 1), ["item_i", "item_j"])
    with pytest.raises(ContractError):
        contracts.covers(df.select("item_i"), df.where("item_i = 'a'").select("item_i"), "item_i")


def test_complete_case_and_seam(spark):
    p = spark.createDataFrame([("x", D(2020, 1, 1), 1.0), ("y", D(2020, 1, 1), None), ("x", D(2020, 1, 2), 2.0), ("y", D(2020, 1, 2), 3.0), ("x", D(2020, 1, 3), float("nan")), ("y", D(2020, 1, 3), 1.0)], "ticker string, Date date, return double")
    assert [r["Date"] for r in panels.complete_case(p).collect()] == [D(2020, 1, 2)] * 2
    train = spark.createDataFrame([("x", D(2020, 1, 1), 100.0), ("x", D(2020, 1, 2), 110.0)], "ticker string, Date date, close_price double")
    later = spark.createDataFrame([("x", D(2020, 1, 2), 999.0), ("x", D(2020, 1, 3), 121.0), ("x", D(2020, 1, 4), 133.1)], "ticker string, Date date, close_price double")
    r = panels.aligned_returns(train, later, start=D(2020, 1, 3)).orderBy("Date").collect()
    assert [round(x["return"], 9) for x in r] == [0.1, 0.1]
    with pytest.raises(ContractError):
        panels.panel_contract(p, tickers=3)
    assert panels.complete_case(p.limit(0)).count() == 0


def test_co_mentions_and_roster(spark):
    e = spark.createDataFrame([("a1", dt.datetime(2019, 12, 31, 23), 2019, "a", "b"), ("a2", dt.datetime(2020, 1, 1), 2020, "B", "a"), ("a3", dt.datetime(2020, 6, 1), 2020, "a", "b"), ("a4", dt.datetime(2021, 6, 1), 2021, "a", "b"), ("a5", dt.datetime(2021, 6, 1), 2021, "a", "c")], "article_id string, created_date timestamp, publication_year long, firm_i string, firm_j string")
    u = spark.createDataFrame([("A",), ("B",)], "Symbol string")
    py = pairs.co_mention_pairs(e, u, D(2020, 1, 1), D(2021, 12, 31))
    got = pairs.adjacency(py, 2).collect()
    assert [(r["firm_i"], r["firm_j"], r["weight"], r["n_years"], r["first_year"], r["last_year"]) for r in got] == [("A", "B", 3, 2, 2020, 2021)]
    with pytest.raises(ContractError):
        pairs.co_mention_pairs(e.withColumn("publication_year", F.lit(1999)))
    y = spark.createDataFrame([(2000, 1), (2001, 1), (2000, 2), (2001, 3)], "year long, gvkey1 long")
    assert pairs.complete_roster(y) == [1, 3]


def test_as_of_and_tails(spark):
    f = spark.createDataFrame([(D(2020, 2, 1),), (D(2020, 3, 1),)], "formation date")
    v = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 2, 1),)], "vintage date")
    assert {r["formation"]: r["vintage"] for r in pairs.latest_before(f, v).collect()} == {D(2020, 2, 1): D(2020, 1, 1), D(2020, 3, 1): D(2020, 2, 1)}
    with pytest.raises(ContractError):
        pairs.latest_before(spark.createDataFrame([(D(2019, 1, 1),)], "formation date"), v)


def test_energy_matches_definition_and_sql_form(spark):
    rng = np.random.default_rng(0)
    sizes = {"a": 7, "b": 5, "c": 1}
    x = {k: rng.normal(size=(n, 4)) for k, n in sizes.items()}
    c = spark.createDataFrame([(k, i, v.tolist()) for k, m in x.items() for i, v in enumerate(m)], "item string, key int, v array<double>")
    mean = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).mean()
    got = {(r["item_i"], r["item_j"]): r["value"] for r in distances.energy(c).collect()}
    assert len(got) == 9 and got["a", "a"] == 0
    assert got["a", "b"] == pytest.approx(2 * mean(x["a"], x["b"]) - mean(x["a"], x["a"]) - mean(x["b"], x["b"]))
    blocks = {(r[0], r[1]): r[2] for r in distances.pair_means(c).select("item_i", "item_j", "mean").collect()}
    sql = {(r[0], r[1]): r[2] for r in distances.pair_means_sql(c).collect()}
    assert blocks.keys() == sql.keys() and all(blocks[k] == pytest.approx(sql[k]) for k in sql)
    distances.BLOCK_BYTES, held = 64, distances.BLOCK_BYTES
    try:
        many = {(r[0], r[1]): r[2] for r in distances.pair_means(c).select("item_i", "item_j", "mean").collect()}
    finally:
        distances.BLOCK_BYTES = held
    assert all(many[k] == pytest.approx(sql[k]) for k in sql)
    with pytest.raises(Exception, match="non-finite|zero"):
        distances.representation(spark.createDataFrame([("a", 1, [0.0, 0.0])], "item string, key int, v array<double>")).collect()
    with pytest.raises(KeyError):
        distances.distance(c, "hausdorff")


def test_node_effects_match_least_squares(spark):
    rng = np.random.default_rng(1)
    n, rows = 8, []
    effect = rng.normal(size=n)
    for i in range(n):
        for j in range(i + 1, n):
            x = rng.normal()
            rows.append((f"n{i}", f"n{j}", float(x), float(2 * x + effect[i] + effect[j] + 0.01 * rng.normal())))
    d = spark.createDataFrame(rows, "item_i string, item_j string, x double, y double")
    fit = regression.dyadic_regression(d, "y", ["x"])
    design = np.array([[r[2], *(float(f"n{k}" in r[:2]) for k in range(n))] for r in rows])
    want = np.linalg.lstsq(design, np.array([r[3] for r in rows]), rcond=None)[0][0]
    assert fit["beta"]["x"] == pytest.approx(want)
    twice = regression.ols(d.withColumn("z", 2 * F.col("x")), "y", ["x", "z"])
    assert twice["beta"]["z"] is None
    _, rows_ = regression.influence(d, "y", ["x"])
    assert rows_.agg(F.sum("leverage")).first()[0] == pytest.approx(2)
    slopes = resampling.bootstrap_slopes(d, resampling.node_counts(spark, [f"n{k}" for k in range(n)], 5, 1), "y", "x")
    assert slopes.count() == 5


def test_credit_identities(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 2))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    sq = spark.createDataFrame([(f"t{i}", f"t{j}", float(d[i, j])) for i in range(4) for j in range(4)], "item_i string, item_j string, value double")
    q = spark.createDataFrame([("p", f"t{i}", 0.25) for i in range(4)], "portfolio string, ticker string, weight double")
    s = spark.createDataFrame([(f"t{i}", "ab"[i % 2]) for i in range(4)], "ticker string, sector string")
    parts = portfolios.credit_decomposition(sq, q, s)
    portfolios.identities(*parts)
    assert portfolios.credit(sq, q).first()["credit"] == pytest.approx(0.5 * np.full(4, 0.25) @ d @ np.full(4, 0.25))


def test_factor_archive(spark, tmp_path):
    path = tmp_path / "f.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("f.csv", "about\n,A,B\n20200102, 1.0, 2.0\n20200103,-1.0,0.5\n2020, 9, 9\n")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    df = factors.read_factors(spark, str(path), ["A", "B"], ["MKT_RF", "RF"], digest)
    assert [tuple(r) for r in df.orderBy("Date").collect()] == [(D(2020, 1, 2), 0.01, 0.02), (D(2020, 1, 3), -0.01, 0.005)]
    with pytest.raises(ContractError):
        factors.read_factors(spark, str(path), ["A", "B"], ["MKT_RF", "RF"], "0" * 64)


def test_readers_and_sinks(spark, tmp_path):
    clouds = spark.createDataFrame([("d", "s", dt.datetime(2020, 1, 2), [1.0, 0.0], 5), ("a", "s", dt.datetime(2020, 1, 1), [0.0, 1.0], 5), ("c", "s", dt.datetime(2021, 1, 1), [0.6, 0.8], 5)], tables.CLOUDS)
    clouds.write.parquet(str(tmp_path / "c"))
    got = tables.clouds(spark, str(tmp_path / "c"), D(2020, 1, 1), D(2020, 12, 31), m=2, width=2, unit_rows=True)
    assert sorted(r["key"] for r in got.collect()) == ["a", "d"]
    with pytest.raises(ContractError):
        tables.clouds(spark, str(tmp_path / "c"), m=4)
    assert tables.key_prefix(got, 1).first()["keys"] == ["a"]
    (tmp_path / "u.csv").write_text("Symbol,Name,Sector,Industry\nab,N,S,I\n")
    assert tables.universe(spark, str(tmp_path / "u.csv")).first()["Symbol"] == "AB"
    (tmp_path / "j.json").write_text('{"a": 1.5, "b": 2}')
    assert {r["key"]: r["value"] for r in tables.json_numbers(spark, str(tmp_path / "j.json")).collect()} == {"a": 1.5, "b": 2.0}
    spark.createDataFrame([([0, 2, 3], [0, 3, 1], [1.0, 1.0, 2.0])], "indptr array<int>, indices array<int>, data array<double>").write.parquet(str(tmp_path / "m"))
    assert {r["row"]: r["weights"] for r in tables.sparse_rows(spark, str(tmp_path / "m")).collect()} == {0: {0: 1.0, 3: 1.0}, 1: {1: 2.0}}
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    digests = sinks.write_tables(str(tmp_path / "out"), {"t": df}, {"n": 2}, {"t": {"v": {"unit": "none"}}})
    assert digests["t"] == documents.table_digest(df.orderBy(F.desc("k")), ["k", "v"])
    assert spark.read.parquet(str(tmp_path / "out" / "t")).schema["v"].metadata == {"unit": "none"}
    tasks = spark.createDataFrame([(1, 1), (1, 2)], "history int, outer int")
    assert sinks.pending(tasks, str(tmp_path / "ck"), ["history", "outer"]).count() == 2
    sinks.write_checkpoint(tasks.where("outer = 1").withColumn("r", F.lit(1.0)), str(tmp_path / "ck"), ["history", "outer"])
    assert sinks.pending(tasks, str(tmp_path / "ck"), ["history", "outer"]).collect() == [(1, 2)]
    sinks.append_json(df, str(tmp_path / "log"))
    sinks.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert sinks.values_latex(spark.createDataFrame([("a", 1.0), ("b", None)], "key string, value double"), 2) == "\\newcommand{\\a}{1.00}\n\\newcommand{\\b}{--}"


def test_documents(tmp_path, spark):
    good = {f: "" for f in documents.MANIFEST_FIELDS} | {"files": {"x.bin": hashlib.sha256(b"x").hexdigest()}}
    (tmp_path / "x.bin").write_bytes(b"x")
    documents.write_manifest(str(tmp_path / "m.json"), good)
    assert documents.check_inputs(spark, str(tmp_path / "x.bin"), good).first()["ok"]
    with pytest.raises(ContractError):
        documents.check_manifest(good | {"files": {"../x": "0" * 64}})
    with pytest.raises(ContractError):
        documents.typed(documents.DistanceSpec, {"distance_id": "a", "family": "energy", "extra": 1})
    with pytest.raises(ContractError):
        documents.typed(documents.DistanceSpec, {"distance_id": "a", "family": "unknown"})
    assert dataclasses.asdict(documents.typed(documents.ProjectionSpec, {"arm_id": "a", "geometry": "mmd"}))["feasible_set"] == "simplex_nonnegative"


def test_replicate_resumes(spark):
    keys = spark.range(4).select(F.col("id").alias("k"))
    done = spark.createDataFrame([(0,), (1,)], "k long")
    out = resampling.replicate(spark, keys, lambda r: {"k": r["k"], "v": float(r["k"]) ** 2}, "k long, v double", done)
    assert sorted(map(tuple, out.collect())) == [(2, 4.0), (3, 9.0)]


def test_factor_residuals_and_gram(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=40)
    rows = [(t, D(2020, 1, 1) + dt.timedelta(days=k), float(1 + 2 * f[k] + 0.1 * rng.normal()), float(f[k])) for t in ("a", "b", "c") for k in range(40)]
    p = spark.createDataFrame(rows, "ticker string, Date date, excess double, MKT double")
    r, beta = spatial.factor_residuals(p, ["MKT"])
    assert all(b["coefficients"] == pytest.approx([1, 2], abs=0.2) for b in beta.collect())
    assert abs(r.agg(F.sum("residual")).first()[0]) < 1e-8
    w = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "target string, candidate string, weight double")
    fit, _ = spatial.sar_factor_qmle(p, w, ["MKT"], ["a", "b", "c"])
    assert -1 < fit.rho < 1
    assert moments.rates(spark.createDataFrame([(1, True, True), (1, False, True), (2, True, False)], "history int, event boolean, available boolean")).first()["rate"] == pytest.approx(0.25)


def test_stream_agrees_with_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3, "ab"[i % 2], float(i), "{}") for i in range(60)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    e.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = windows.event_windows(windows.read_events(spark, str(tmp_path / "events")), "1 day", late="100 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.event_windows(e, "1 day")
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))
    assert windows.sessions(e, "90 minutes").count() == 60


def test_studies(spark):
    from lodestrata.operators import studies

    rng = np.random.default_rng(8)
    days = [D(2020, 1, 1) + dt.timedelta(days=k) for k in range(120)]
    p = spark.createDataFrame([(t, d, float(s * rng.normal())) for t, s in (("a", 1.0), ("b", 2.0), ("c", 3.0)) for d in days], "ticker string, Date date, return double")
    f = panels.first_of_month(p, 20, 10)
    w = studies.formation_weights(p, f, 20, 10)
    assert w.groupBy("formation", "portfolio").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    e = {r["portfolio"]: r for r in studies.formation_evaluation(p, f, w, 20, 10).collect()}
    assert set(e) == {"equal", "inverse_volatility", "minimum_variance"} and e["equal"]["turnover"] == pytest.approx(0)
    assert e["minimum_variance"]["variance"] < e["equal"]["variance"]
    c = spark.createDataFrame([(t, k, d, rng.normal(size=4).tolist()) for t in "ab" for k, d in enumerate(days[:6])], "item string, key int, date date, v array<double>")
    v = studies.vintage_distances(c, [days[3], days[5]], 4)
    assert v.count() == 2
    assert studies.dimension_ladder(c, [2, 4], 5).count() == 2
    laws = spark.createDataFrame([("x", 1, 0, [0.0], 1.0), ("y", 1, 0, [0.0], 0.5), ("y", 1, 1, [2.0], 0.5), ("x", 2, 0, [2.0], 1.0)], "firm string, year int, atom int, v array<double>, mass double")
    d = {(r["year"], r["target"], r["reference"]): r["value"] for r in studies.directed_distances(laws, 1).collect()}
    assert d[1, "x", "y"] == pytest.approx(2**0.5) and d[2, "x", "y"] == pytest.approx(2**0.5) and (1, "x", "x") not in d
    docs = spark.createDataFrame([(1, "red green"), (2, "red green"), (3, "blue")], "doc int, text string")
    from lodestrata.sources.tables import cosine_of_sparse

    sparse = studies.tfidf(docs).select(F.col("doc").alias("row"), "weights")
    assert [(r["row_i"], r["row_j"]) for r in cosine_of_sparse(sparse).collect()] == [(1, 2)] and cosine_of_sparse(sparse).first()["distance"] == pytest.approx(0)
    m = spark.createDataFrame([(0, f"t{i}", f"t{j}", float((i - j) ** 2)) for i in range(3) for j in range(3)], "draw long, item_i string, item_j string, value double")
    s = {r["ticker"]: r["weight"] for r in studies.weight_stability(m).collect()}
    assert s["t0"] == pytest.approx(0.5, abs=1e-5) and s["t2"] == pytest.approx(0.5, abs=1e-5)
    assert studies.placebo(m.select("item_i", "item_j", "value"), ["t0", "t1", "t2"], 1).count() == 9
