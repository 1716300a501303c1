"""Directional moments over (year, target, reference) cells, and rates over replications.

Cells: year, target, reference, distance, financial; target = reference cells are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ranks import linear_quantiles
from lodestrata.sources.contracts import none, require


def _off(cells: DataFrame) -> DataFrame:
    return cells.where("target <> reference")


def centred(cells: DataFrame, columns: list[str], by: tuple[str, ...] = ("year", "target")) -> DataFrame:
    """Each column less its mean over the other references of its year and target, by a join of partial means."""
    means = _off(cells).groupBy(*by).agg(*(F.avg(c).alias("_m_" + c) for c in columns))
    out = _off(cells).join(means, list(by))
    return out.withColumns({c: F.col(c) - F.col("_m_" + c) for c in columns}).drop(*("_m_" + c for c in columns))


def annual_moments(cells: DataFrame) -> DataFrame:
    """(year, product, square): means over cells of the centred product of financial with distance, and of squared distance."""
    c = centred(cells, ["financial", "distance"])
    return c.groupBy("year").agg(F.avg(F.col("financial") * F.col("distance")).alias("product"), F.avg(F.col("distance") * F.col("distance")).alias("square"))


def pooled_slope(cells: DataFrame) -> DataFrame:
    """Sum of centred products over sum of centred squares; null where that is zero."""
    c = centred(cells, ["financial", "distance"])
    return c.agg((F.sum(F.col("financial") * F.col("distance")) / F.nullif(F.sum(F.col("distance") * F.col("distance")), F.lit(0.0))).alias("slope"))


def contributions(cells: DataFrame, axis: str) -> DataFrame:
    """Each axis value's share of the pooled numerator's and denominator's sums."""
    c = centred(cells, ["financial", "distance"])
    part = c.groupBy(axis).agg(F.sum(F.col("financial") * F.col("distance")).alias("numerator"), F.sum(F.col("distance") * F.col("distance")).alias("denominator"))
    whole = part.agg(F.sum("denominator").alias("_d"))
    return part.join(F.broadcast(whole), F.lit(True)).select(axis, (F.col("numerator") / F.col("_d")).alias("contribution"), (F.col("denominator") / F.col("_d")).alias("share"))


#: Fixed value: the normal quantile of a one-sided bound at 95 percent.
ONE_SIDED_Z = 1.6448536269514722
LEAST_FIRMS = 4


def firm_projections(cells: DataFrame) -> DataFrame:
    """(year, firm, numerator, denominator, n): each firm's first projection of the symmetric triple kernel of the centred products.

    The kernel of a triple is a third of the sum, over its members as targets, of the products of differences of their two
    references; every year has to hold all pairs of its firms. A firm's triples add up to ((n - 2) row + (n - 1) column + total) / 3 of the centred products' sums, so three
    aggregations take the place of n^3 triples.
    """
    c = centred(cells, ["financial", "distance"])
    terms = {"q": F.col("financial") * F.col("distance"), "d": F.col("distance") * F.col("distance")}
    total = c.groupBy("year").agg(F.count_distinct("target").alias("n"), F.count(F.lit(1)).alias("_cells"), *(F.sum(t).alias(f"{k}_all") for k, t in terms.items()))
    require(total, complete=none(F.col("_cells") != F.col("n") * (F.col("n") - 1)))
    row = c.groupBy("year", F.col("target").alias("firm")).agg(*(F.sum(t).alias(f"{k}_row") for k, t in terms.items()))
    column = c.groupBy("year", F.col("reference").alias("firm")).agg(*(F.sum(t).alias(f"{k}_col") for k, t in terms.items()))
    met = row.join(column, ["year", "firm"], "full").join(F.broadcast(total), "year")  # a row for each year
    n, none_ = F.col("n"), F.lit(0.0)

    def phi(k: str) -> Column:
        own = (n - 2) * F.coalesce(f"{k}_row", none_) + (n - 1) * F.coalesce(f"{k}_col", none_) + F.col(f"{k}_all")
        return own / ((n - 1) * (n - 1)) - 3 * F.col(f"{k}_all") / (n * (n - 1))

    return met.select("year", "firm", phi("q").alias("numerator"), phi("d").alias("denominator"), "n")


def projection_audit(cells: DataFrame) -> DataFrame:
    """One row: slope, numerator, denominator, se, lower, firms, status of the pooled slope under firms as independent histories.

    status: defined; zero_denominator (no slope); degenerate_projection (no spread of the firms' influence, so no bound);
    too_few_firms (fewer than four).
    """
    c = centred(cells, ["financial", "distance"])
    x, y = F.col("distance"), F.col("financial")
    year = c.groupBy("year").agg(F.avg(y * x).alias("q"), F.avg(x * x).alias("d"))
    whole = year.agg(F.sum("q").alias("numerator"), F.sum("d").alias("denominator"))
    whole = whole.withColumn("slope", F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0.0)))
    f = firm_projections(cells).withColumnsRenamed({"numerator": "phi_q", "denominator": "phi_d"}).join(F.broadcast(whole), F.lit(True))
    influence = f.groupBy("firm").agg((F.sum(F.col("phi_q") - F.col("slope") * F.col("phi_d")) / F.nullif(F.first("denominator"), F.lit(0.0))).alias("i"))
    spread = influence.agg(F.count(F.lit(1)).alias("firms"), F.sqrt(F.var_samp("i") / F.count(F.lit(1))).alias("se"), F.max(F.abs("i")).alias("_most"))
    few = F.col("firms") < LEAST_FIRMS
    status = F.when(few, "too_few_firms").when(F.col("slope").isNull(), "zero_denominator").when(F.col("se") <= 1e-14 * F.greatest(F.col("_most"), F.lit(1e-300)), "degenerate_projection").otherwise("defined")
    out = whole.join(spread, F.lit(True), "left").withColumn("status", status)
    known = F.col("status") == "defined"
    return out.select("slope", "numerator", "denominator", F.when(known, F.col("se")).when(F.col("status") == "degenerate_projection", 0.0).alias("se"), F.when(known, F.col("slope") - ONE_SIDED_Z * F.col("se")).alias("lower"), F.coalesce("firms", F.lit(0)).alias("firms"), F.coalesce("status", F.lit("too_few_firms")).alias("status"))


def leave_one_year(cells: DataFrame) -> DataFrame:
    """(year, slope) without each year: its centred sums are taken off the totals."""
    c = centred(cells, ["financial", "distance"])
    part = c.groupBy("year").agg(F.sum(F.col("financial") * F.col("distance")).alias("n"), F.sum(F.col("distance") * F.col("distance")).alias("d"))
    whole = part.agg(F.sum("n").alias("nt"), F.sum("d").alias("dt"))
    return part.join(F.broadcast(whole), F.lit(True)).select("year", ((F.col("nt") - F.col("n")) / F.nullif(F.col("dt") - F.col("d"), F.lit(0.0))).alias("slope"))


def leave_one_firm(cells: DataFrame) -> DataFrame:
    """(firm, slope) without each firm in either role, centred again over the references that remain.

    Centring without a reference is the group's sums less that reference's cell, so cells are not copied for each firm: the slope
    needs sum xy - sum x sum y / n of each group, and the removed cell's share of them.
    """
    off = _off(cells)
    x, y = F.col("distance"), F.col("financial")
    names = ("n", "sx", "sy", "sxy", "sxx")
    terms = (F.lit(1.0), x, y, x * y, x * x)
    group = off.groupBy("year", "target").agg(*(F.sum(t).alias(n) for t, n in zip(terms, names, strict=True)))

    def centre(n, sx, sy, sxy, sxx) -> tuple[Column, Column]:
        size = F.nullif(n, F.lit(0.0))
        return F.coalesce(sxy - sx * sy / size, F.lit(0.0)), F.coalesce(sxx - sx * sx / size, F.lit(0.0))

    a, b = centre(*(F.col(n) for n in names))
    full = group.select("year", "target", a.alias("a"), b.alias("b"))
    total = full.agg(F.sum("a").alias("at"), F.sum("b").alias("bt"))
    as_target = full.groupBy(F.col("target").alias("firm")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # a firm as a reference: its groups change from the full sums to those without its cell
    cell = off.join(group, ["year", "target"])
    a2, b2 = centre(*(F.col(n) - t for n, t in zip(names, terms, strict=True)))
    change = cell.select(F.col("reference").alias("firm"), (a - a2).alias("a"), (b - b2).alias("b")).groupBy("firm").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    gone = as_target.unionByName(change).groupBy("firm").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return gone.join(F.broadcast(total), F.lit(True)).select("firm", F.when(F.col("bt") - F.col("b") > 1e-12 * F.col("bt"), (F.col("at") - F.col("a")) / (F.col("bt") - F.col("b"))).alias("slope"))


def corporate_summary(cells: DataFrame) -> DataFrame:
    """(year, share, herfindahl, alignment): each year's share of distance, its concentration over targets, and cosine alignment."""
    off = _off(cells)
    by_target = off.groupBy("year", "target").agg(F.sum("distance").alias("d"), F.sum(F.col("distance") * F.col("financial")).alias("xy"), F.sum(F.col("distance") * F.col("distance")).alias("xx"), F.sum(F.col("financial") * F.col("financial")).alias("yy"))
    year = by_target.groupBy("year").agg(F.sum("d").alias("d"), (F.sum(F.col("d") * F.col("d")) / (F.sum("d") * F.sum("d"))).alias("herfindahl"), (F.sum("xy") / F.sqrt(F.sum("xx") * F.sum("yy"))).alias("alignment"))
    whole = year.agg(F.sum("d").alias("_t"))
    return year.join(F.broadcast(whole), F.lit(True)).select("year", (F.col("d") / F.col("_t")).alias("share"), "herfindahl", "alignment")


def pooled_laws(laws: DataFrame) -> DataFrame:
    """(year, firm, atom, mass): monthly masses (year, month, firm, atom, mass, n) weighted by article counts."""
    return laws.groupBy("year", "firm", "atom").agg((F.sum(F.col("mass") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mass"))


def triple_moments(cells: DataFrame) -> DataFrame:
    """(year, moment): mean over triples of different firms of the symmetric kernel of financial and distance.

    Sums over i of (sum_j f_ij)(sum_k d_ik) less the j = k terms give all ordered triples at once, so the cost is that of pairs.
    """
    rows = _off(cells).groupBy("year", F.col("target").alias("i")).agg(F.sum("financial").alias("f"), F.sum("distance").alias("d"), F.sum(F.col("financial") * F.col("distance")).alias("same"), F.count(F.lit(1)).alias("m"))
    n = F.count(F.lit(1))
    return rows.groupBy("year").agg((F.sum(F.col("f") * F.col("d") - F.col("same")) / F.nullif((n * (n - 1) * (n - 2)).cast("double"), F.lit(0.0))).alias("moment"))


def rates(replications: DataFrame) -> DataFrame:
    """(rate, mcse): mean over histories of the event rate within each, unavailable replications counted as no event."""
    h = replications.groupBy("history").agg(F.avg(F.when(F.col("available") & F.col("event"), 1.0).otherwise(0.0)).alias("p"), F.count(F.lit(1)).alias("n"))
    k = F.count(F.lit(1))
    return h.agg(F.avg("p").alias("rate"), (F.sqrt(F.sum(F.col("p") * (1 - F.col("p")) / F.greatest(F.col("n") - 1, F.lit(1)))) / k).alias("mcse"), k.alias("histories"))


def outer_summary(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Availability and outcomes of the complete (scenario, history, outer) roster: a missing result counts as unavailable."""
    key = ["scenario", "history", "outer"]
    met = tasks.join(results, key, "left").withColumn("available", F.coalesce("available", F.lit(False)))
    q = linear_quantiles("estimate", [0.025, 0.05, 0.975])
    known = met.withColumn("estimate", F.when(F.col("available"), F.col("estimate")))
    return known.groupBy("scenario").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("available").alias("available"), F.avg("estimate").alias("mean"), q[0].alias("q025"), q[1].alias("q050"), q[2].alias("q975"))


def bound_diagnostics(draws: DataFrame, target: float, z: float = 1.6448536269514722) -> DataFrame:
    """Counts of undefined, unavailable, degenerate and usable estimates, and rates of containment and positive bounds over all attempts."""
    undefined = F.col("estimate").isNull()
    unavailable = ~undefined & F.col("se").isNull()
    degenerate = ~undefined & ~unavailable & (F.col("se") == 0)
    usable = ~undefined & ~unavailable & ~degenerate
    lower = F.col("estimate") - z * F.col("se")
    rate = lambda c: F.avg(F.when(usable & c, 1.0).otherwise(0.0))
    out = draws.agg(F.count(F.lit(1)).alias("n"), F.count_if(undefined).alias("undefined"), F.count_if(unavailable).alias("unavailable"), F.count_if(degenerate).alias("degenerate"), F.count_if(usable).alias("usable"), rate(lower <= target).alias("contains"), rate(lower > 0).alias("positive"))
    se = lambda c: F.sqrt(F.col(c) * (1 - F.col(c)) / F.nullif(F.col("n") - 1, F.lit(0)))
    return out.withColumns({"contains_se": se("contains"), "positive_se": se("positive")})


def directional_performance(draws: DataFrame) -> DataFrame:
    """(stratum, above, below, unresolved, undefined, correct_sign, rmse) of estimates against an oracle, over all attempts.

    draws: stratum, estimate, oracle, sign (1, -1 or 0), oracle_sign. Magnitudes are null if any draw is undefined.
    """
    defined = F.col("estimate").isNotNull()
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    gap = F.col("estimate") - F.col("oracle")
    return draws.groupBy("stratum").agg(rate(defined & (F.col("sign") > 0)).alias("above"), rate(defined & (F.col("sign") < 0)).alias("below"), rate(defined & (F.col("sign") == 0)).alias("unresolved"), rate(~defined).alias("undefined"), F.when(F.max(F.abs("oracle_sign")) > 0, rate(defined & (F.col("sign") == F.col("oracle_sign")))).alias("correct_sign"), F.when(F.count_if(~defined | F.col("oracle").isNull()) == 0, F.sqrt(F.avg(gap * gap))).alias("rmse"))


def stage_costs(runs: DataFrame) -> DataFrame:
    """Count, median, maximum and rounded mean of wall seconds by stage, dearest first."""
    return runs.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.median("wall_s").alias("median_s"), F.max("wall_s").alias("max_s"), F.round(F.avg("wall_s"), 3).alias("mean_s")).orderBy(F.desc("median_s"), "stage")


def quantile_bins(df: DataFrame, x: str, y: str, bins: int, ranges: int = 64) -> DataFrame:
    """Means of x and y over bins of equal counts in the order of x, then y; the first bins take the remainder.

    Rows are numbered without one task that sees them all: approximate quantiles of x cut them into ranges, whose counts (a row for
    each range) give the number that each range begins with.
    """
    cuts = sorted(set(df.approxQuantile(x, [k / ranges for k in range(1, ranges)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(x))) if cuts else F.lit(0)
    ranged = df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), part.alias("_p"))
    counts = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    before, at = [], 0
    for p, n in counts:
        before += [F.lit(p), F.lit(at)]
        at += n
    if not total:
        return df.sparkSession.createDataFrame([], "bin int, x double, y double, n long")
    number = F.create_map(*before)[F.col("_p")] + F.row_number().over(Window.partitionBy("_p").orderBy("_x", "_y")) - 1
    each, more = divmod(total, bins)
    large = more * (each + 1)
    k = F.when(number < large, F.floor(number / (each + 1))).otherwise(more + F.floor((number - large) / max(each, 1))) + 1
    return ranged.withColumn("bin", k.cast("int")).groupBy("bin").agg(F.avg("_x").alias("x"), F.avg("_y").alias("y"), F.count(F.lit(1)).alias("n"))
