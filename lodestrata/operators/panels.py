"""Dated panels in long form: (ticker, Date, value). Nothing is pivoted before the driver's edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ranks import keep_first
from lodestrata.operators.ordered import sized
from lodestrata.sources.contracts import ContractError, none, require, unique


def fine(x: str) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def complete_case(panel: DataFrame, value: str = "return", ticker: str = "ticker", date: str = "Date", roster: int | None = None) -> DataFrame:
    """Rows of dates on which every ticker has a finite value. One aggregation by date, no join for each ticker."""
    n = panel.select(ticker).distinct().count() if roster is None else roster
    kept = panel.where(fine(value)).groupBy(date).agg(F.count_distinct(ticker).alias("_n")).where(F.col("_n") == n)
    return panel.where(fine(value)).join(kept.select(date), date, "left_semi")


def percent_change(prices: DataFrame, value: str = "close_price", ticker: str = "ticker", date: str = "Date") -> DataFrame:
    """Adds return: value over the previous one less 1, null on a ticker's first date."""
    w = Window.partitionBy(ticker).orderBy(date)
    return prices.withColumn("return", F.col(value) / F.lag(value).over(w) - 1)


def aligned_returns(train: DataFrame, evaluation: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """Complete-case (ticker, Date, return). With evaluation prices the two are joined at the seam: the first row of a date
    stays, returns are recomputed from prices, and only then are dates filtered."""
    if evaluation is None:
        long = train.select("ticker", "Date", "return")
    else:
        cols = ["ticker", "Date", "close_price"]
        both = train.select(*cols, F.lit(0).alias("_src")).unionByName(evaluation.select(*cols, F.lit(1).alias("_src")))
        long = percent_change(keep_first(both, ["ticker", "Date"], ["_src", "close_price"])).select("ticker", "Date", "return")
    if start is not None:
        long = long.where(F.col("Date") >= F.lit(start))
    if end is not None:
        long = long.where(F.col("Date") <= F.lit(end))
    return complete_case(long)


def chronological_returns(calibration: DataFrame, holdout: DataFrame) -> DataFrame:
    """Complete-case (ticker, Date, return) of both, where the later table's row of a date stays and returns are as stored."""
    cols = ["ticker", "Date", "return"]
    both = calibration.select(*cols, F.lit(0).alias("_src")).unionByName(holdout.select(*cols, F.lit(1).alias("_src")))
    return complete_case(keep_first(both, ["ticker", "Date"], [F.desc("_src"), "return"]).select(cols))


def calendar_returns(returns: DataFrame, first, last, dates: int) -> DataFrame:
    """Adds log_return and its running sum, for a panel whose tickers all have the same number of dates, first to last."""
    w = Window.partitionBy("ticker").orderBy("Date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = returns.where(F.col("Date").between(first, last))
    require(kept, above=none(~fine("return") | (F.col("return") <= -1)))
    per = unique(kept, "ticker", "Date").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("lo"), F.max("Date").alias("hi"))
    require(per, calendar=none((F.col("n") != dates) | (F.col("lo") != F.lit(first)) | (F.col("hi") != F.lit(last))))
    return kept.withColumn("log_return", F.log1p("return")).withColumn("cumulative", F.sum("log_return").over(w))


def panel_contract(panel: DataFrame, tickers: int | None = None, observations: int | None = None, start=None, end=None, minimum: int = 2) -> DataFrame:
    """panel, if its tickers, dates and ends are as expected."""
    row = panel.agg(F.count_distinct("ticker").alias("t"), F.count_distinct("Date").alias("d"), F.min("Date").alias("lo"), F.max("Date").alias("hi")).first()
    for what, have, want in (("tickers", row["t"], tickers), ("observations", row["d"], observations), ("start", row["lo"], start), ("end", row["hi"], end)):
        if want is not None and have != want:
            raise ContractError(f"{what}: {have}, not {want}")
    if row["d"] < minimum:
        raise ContractError(f"{row['d']} dates, at least {minimum} needed")
    return panel


def wide(panel: DataFrame, tickers: list[str], value: str = "return") -> DataFrame:
    """A column for each ticker, in order; a ticker twice on a date is an error (it would be arbitrary otherwise)."""
    return unique(panel, "ticker", "Date").groupBy("Date").pivot("ticker", tickers).agg(F.first(value)).orderBy("Date")


def first_of_month(dates: DataFrame, lookback: int = 0, horizon: int = 0) -> DataFrame:
    """(Date, position): the first date of each calendar month that has lookback dates before and horizon from it on."""
    # a calendar is a few thousand rows at any scale of the panel
    numbered = dates.select("Date").distinct().withColumn("position", F.row_number().over(Window.partitionBy().orderBy("Date")))
    n = numbered.count()
    first = numbered.groupBy(F.trunc("Date", "month").alias("month")).agg(F.min(F.struct("Date", "position")).alias("f")).select("f.*")
    return first.where((F.col("position") > lookback) & (F.col("position") + horizon - 1 <= n))


def trailing_and_forward(panel: DataFrame, formations: DataFrame, calendar: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Rows of the lookback dates strictly before each formation (side trailing) and of the horizon dates from it (forward)."""
    numbered = calendar.select("Date").distinct().withColumn("p", F.row_number().over(Window.partitionBy().orderBy("Date")))
    spans = formations.select(F.col("Date").alias("formation"), F.col("position").alias("f")).withColumn("p", F.explode(F.sequence(F.col("f") - lookback, F.col("f") + (horizon - 1))))
    keyed = spans.join(sized(numbered), "p").select("formation", "Date", F.when(F.col("p") < F.col("f"), "trailing").otherwise("forward").alias("side"))
    return panel.join(sized(keyed), "Date")


def covariance_long(panel: DataFrame, value: str = "return", ticker: str = "ticker", date: str = "Date") -> DataFrame:
    """All ordered pairs: ticker_i, ticker_j, covariance (ddof 1), correlation, variance_i, variance_j."""
    a = panel.select(F.col(date), F.col(ticker).alias("ticker_i"), F.col(value).alias("x"))
    b = panel.select(F.col(date), F.col(ticker).alias("ticker_j"), F.col(value).alias("y"))
    return a.join(b, date).groupBy("ticker_i", "ticker_j").agg(F.covar_samp("x", "y").alias("covariance"), F.corr("x", "y").alias("correlation"), F.var_samp("x").alias("variance_i"), F.var_samp("y").alias("variance_j"))


def upper(pairs: DataFrame, i: str = "ticker_i", j: str = "ticker_j") -> DataFrame:
    return pairs.where(F.col(i) < F.col(j))


def volatility(panel: DataFrame, value: str = "return", ticker: str = "ticker") -> DataFrame:
    """Sample standard deviation; null with fewer than two values."""
    return panel.where(fine(value)).groupBy(ticker).agg(F.when(F.count(F.lit(1)) >= 2, F.stddev_samp(value)).alias("volatility"))


def standardized(panel: DataFrame, value: str = "return", ticker: str = "ticker") -> DataFrame:
    """value over its ticker's sample standard deviation, not centred."""
    sd = panel.groupBy(ticker).agg(F.stddev_samp(value).alias("sd"))
    return panel.join(sd, ticker).withColumn("standardized", F.col(value) / F.col("sd"))


def portfolio_variance(panel: DataFrame, weights: DataFrame, value: str = "return") -> DataFrame:
    """Variance (ddof 1) over dates of each portfolio's weighted sum. weights: (portfolio, ticker, weight)."""
    daily = panel.join(weights, "ticker").groupBy("portfolio", "Date").agg(F.sum(F.col("weight") * F.col(value)).alias("r"))
    return daily.groupBy("portfolio").agg(F.var_samp("r").alias("variance"), F.count(F.lit(1)).alias("dates"))


def inside_window(panel: DataFrame, roster: DataFrame, start, end) -> DataFrame:
    """(ticker, flag): 1 where any row of the ticker falls inside the window, else 0."""
    hit = panel.groupBy("ticker").agg(F.max(F.when(F.col("Date").between(start, end), 1).otherwise(0)).alias("flag"))
    return roster.join(hit, "ticker", "left").select("ticker", F.coalesce("flag", F.lit(0)).alias("flag"))


def align_factors(returns: DataFrame, factors: DataFrame, minimum: int = 30) -> DataFrame:
    """Excess returns with their date's factors; dates without a complete factor row go, and too few dates are an error."""
    names = [c for c in factors.columns if c != "Date"]
    out = returns.join(unique(factors, "Date").dropna(subset=names), "Date").withColumn("excess", F.col("return") - F.col("RF"))
    if out.select("Date").distinct().count() < minimum:
        raise ContractError(f"fewer than {minimum} dates")
    return out


def autocorrelation_block_length(series: DataFrame, value: str = "return", cutoff: float = 0.1, longest: int = 50) -> DataFrame:
    """First lag whose autocorrelation is below cutoff, else the cube root of the length rounded up, for each ticker."""
    w = Window.partitionBy("ticker").orderBy("Date")
    x = series.withColumn("t", F.row_number().over(w))
    m = x.groupBy("ticker").agg(F.avg(value).alias("m"), F.sum(F.lit(1)).alias("n"), (F.var_pop(value) * F.count(F.lit(1))).alias("ss"))
    c = x.join(m, "ticker").withColumn("d", F.col(value) - F.col("m"))
    a = c.select("ticker", "t", "d", "n", "ss", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("lag"))
    b = c.select("ticker", (F.col("t")).alias("u"), F.col("d").alias("e"))
    acf = a.join(b, (a["ticker"] == b["ticker"]) & (a["t"] + a["lag"] == b["u"])).groupBy(a["ticker"], "lag").agg((F.sum(F.col("d") * F.col("e")) / F.first("ss")).alias("acf"), F.first("n").alias("n"))
    first = acf.groupBy("ticker").agg(F.min(F.when(F.col("acf") < cutoff, F.col("lag"))).alias("lag"), F.first("n").alias("n"))
    return first.select("ticker", F.coalesce("lag", F.ceil(F.cbrt("n"))).cast("long").alias("block_length"))
