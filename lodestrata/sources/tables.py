"""Typed readers: explicit schemas, pruned columns, filters that reach the Parquet scan, contracts checked by one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import arrays as A
from lodestrata.operators.ordered import sized
from lodestrata.sources.contracts import ContractError, covers, none, require, row_stochastic, square, unique

_f = T.StructField
RETURNS = T.StructType([_f("Date", T.TimestampType()), _f("ticker", T.StringType()), _f("close_price", T.DoubleType()), _f("return", T.DoubleType())])
CLOUDS = T.StructType([_f("url_hash", T.StringType()), _f("symbol", T.StringType()), _f("created_date", T.TimestampType()), _f("embedding", T.ArrayType(T.FloatType())), _f("text_length", T.LongType())])
PAIRS = T.StructType([_f("item_i", T.StringType()), _f("item_j", T.StringType()), _f("value", T.DoubleType())])
COVARIANCE = T.StructType([_f(n, T.StringType()) for n in ("ticker_i", "ticker_j")] + [_f(n, T.DoubleType()) for n in ("covariance", "correlation", "variance_i", "variance_j")])
WEIGHTS = T.StructType([_f("target", T.StringType()), _f("candidate", T.StringType()), _f("weight", T.DoubleType())])
UNIVERSE = T.StructType([_f(n, T.StringType()) for n in ("Symbol", "Name", "Sector", "Industry")])
CROSSWALK = T.StructType([_f("ticker", T.StringType()), _f("cik", T.StringType()), _f("gvkey", T.LongType())])
TELEMETRY = T.StructType([_f("ts", T.StringType()), _f("app", T.StringType()), _f("stage", T.StringType()), _f("wall_s", T.DoubleType()), _f("peak_rss_gb", T.DoubleType()), _f("mean_cpu", T.DoubleType()), _f("peak_cpu", T.DoubleType()), _f("n_cpu", T.LongType()), _f("host", T.StringType()), _f("git_sha", T.StringType()), _f("xla_compiles", T.LongType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returns(spark: SparkSession, path: str | list[str], start=None, end=None) -> DataFrame:
    """Date, ticker, return of many files at once, null returns left out in the scan; NaN stays for complete-case rules."""
    df = spark.read.schema(RETURNS).parquet(*([path] if isinstance(path, str) else path)).select("Date", "ticker", "return").where("return is not null")
    if start is not None:
        df = df.where(F.col("Date") >= F.lit(start))
    return df if end is None else df.where(F.col("Date") <= F.lit(end))


def prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RETURNS).parquet(path).select("Date", "ticker", "close_price", "return")


def roster(panel: DataFrame, key: str = "ticker") -> DataFrame:
    """Distinct keys in order."""
    return panel.select(key).distinct().orderBy(key)


def clouds(spark: SparkSession, path: str, start=None, end=None, m: int | None = None, width: int | None = None, unit_rows: bool = False) -> DataFrame:
    """(item, key, date, v): window (both ends count), then the first m rows of each item by key; a short item is an error."""
    df = spark.read.schema(CLOUDS).parquet(path).select(F.col("symbol").alias("item"), F.col("url_hash").alias("key"), F.to_date("created_date").alias("date"), F.col("embedding").alias("v"))
    if start is not None or end is not None:
        require(df, dated=none(F.col("date").isNull()))
        df = df if start is None else df.where(F.col("date") >= F.lit(start))
        df = df if end is None else df.where(F.col("date") <= F.lit(end))
    if df.isEmpty():
        raise ContractError("no row in the window")
    unique(df, "item", "key")
    if m is not None:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy("key"))).where(F.col("_r") <= m).drop("_r")
        require(df.groupBy("item").count(), rows=none(F.col("count") < m))
    checks = {"finite": none(~A.all_finite("v"))}
    if width is not None:
        checks["width"] = none(F.size("v") != width)
    if unit_rows:
        checks["unit"] = none(F.abs(A.norm(A.doubles("v")) - 1) > 1e-5)
    return require(df, **checks)


def key_prefix(df: DataFrame, m: int) -> DataFrame:
    """(item, keys): the first m keys of each item, to compare readers of different models."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy("key"))).where(F.col("_r") <= m)
    return first.groupBy("item").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def coverage(df: DataFrame, m: int, width: int) -> DataFrame:
    """(item, rows, dim, nan_values, zero_rows, ok, short) of clouds."""
    zero = F.forall("v", lambda x: x == 0)
    nan = F.size(F.filter("v", lambda x: F.isnan(x) | x.isNull()))
    out = df.groupBy("item").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("v")).cast("long").alias("dim"), F.sum(nan).alias("nan_values"), F.count_if(zero).alias("zero_rows"))
    return out.withColumns({"ok": (F.col("rows") >= m) & (F.col("dim") == width) & (F.col("nan_values") == 0) & (F.col("zero_rows") == 0), "short": F.col("rows") < m})


def distance_pairs(spark: SparkSession, path: str) -> DataFrame:
    """All n^2 cells, checked to be finite and symmetric with a zero diagonal."""
    return square(spark.read.schema(PAIRS).parquet(path))


def upper_pairs(pairs: DataFrame, name: str) -> DataFrame:
    """(ticker_i, ticker_j, name) of i < j."""
    return pairs.where("item_i < item_j").select(F.col("item_i").alias("ticker_i"), F.col("item_j").alias("ticker_j"), F.col("value").alias(name))


def energy_dyads(pairs: DataFrame, cloud: DataFrame) -> DataFrame:
    """Upper pairs of the energy metric with the number of rows of both clouds."""
    n = cloud.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    p = upper_pairs(pairs, "functional").withColumn("energy_distance", A.root("functional"))
    return p.join(n.toDF("ticker_i", "n_samples_i"), "ticker_i").join(n.toDF("ticker_j", "n_samples_j"), "ticker_j")


def covariance(spark: SparkSession, path: str) -> DataFrame:
    """The upper triangle in pair order; duplicates and nulls are errors."""
    df = unique(spark.read.schema(COVARIANCE).parquet(path), "ticker_i", "ticker_j")
    require(df, values=none(F.col("covariance").isNull()))
    return df.where("ticker_i < ticker_j").orderBy("ticker_i", "ticker_j")


def field(spark: SparkSession, path: str) -> DataFrame:
    return row_stochastic(spark.read.schema(WEIGHTS).parquet(path))


def universe(spark: SparkSession, path: str, tickers: DataFrame | None = None) -> DataFrame:
    """Symbol (upper case), Name, Sector, Industry of a CSV file; with tickers (Symbol) it must cover exactly those."""
    df = spark.read.option("header", True).schema(UNIVERSE).csv(path).withColumn("Symbol", F.upper(F.trim("Symbol")))
    return df if tickers is None else covers(df, tickers, "Symbol")


def crosswalk(spark: SparkSession, path: str, of: DataFrame) -> DataFrame:
    """ticker, cik (as text), gvkey joined to the universe."""
    return spark.read.option("header", True).schema(CROSSWALK).csv(path).join(sized(of), F.col("ticker") == F.col("Symbol"))


def json_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of JSON files with one object of numbers each, a file a task; a value that is not finite is an error."""
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "value"))
    return require(df, finite=none(F.col("value").isNull() | F.isnan("value")))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).json(path)


def sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row, weights map<int,double>) from CSR arrays in Parquet (indptr, indices, data).

    A matrix may be cut into blocks of rows, each with arrays of its own and `start`, its first row; blocks are then read apart.
    """
    m = spark.read.parquet(path)
    m = m.select("indptr", "indices", "data", (F.col("start") if "start" in m.columns else F.lit(0)).cast("int").alias("start"))
    rows = m.select(F.posexplode(F.slice("indptr", 1, F.size("indptr") - 1)).alias("row", "lo"), "indptr", "indices", "data", "start")
    hi = F.get("indptr", F.col("row") + 1)
    n = (hi - F.col("lo")).cast("int")
    at = (F.col("lo") + 1).cast("int")
    return rows.select((F.col("start") + F.col("row")).alias("row"), F.map_from_arrays(F.slice("indices", at, n), F.slice("data", at, n)).alias("weights"))


def cosine_of_sparse(rows: DataFrame) -> DataFrame:
    """(row_i, row_j, distance) of sparse rows that share a column: one join on columns, never a dense product."""
    x = rows.select("row", F.explode("weights").alias("column", "x"))
    n = x.groupBy("row").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    u = x.join(n, "row").select("row", "column", (F.col("x") / F.col("n")).alias("x"))
    a, b = u.toDF("row_i", "column", "x"), u.toDF("row_j", "column", "y")
    return a.join(b, "column").where("row_i < row_j").groupBy("row_i", "row_j").agg((1 - F.sum(F.col("x") * F.col("y"))).alias("distance"))


def ordered_dates(df: DataFrame, key: str, year: int) -> DataFrame:
    """df, if the dates of each key are different and all in the year, and values finite."""
    unique(df, key, "Date")
    return require(df, year=none(F.year("Date") != year), finite=none(F.isnan("value") | F.col("value").isNull()))
