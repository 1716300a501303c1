"""Undirected and directed pair tables: co-occurrence networks, dyad joins, as-of and tail joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ranks import top_k
from lodestrata.operators.ordered import average_ranks, running_totals
from lodestrata.shared import kept
from lodestrata.sources.contracts import ContractError, none, require, unique, unique_pair


def co_mention_pairs(events: DataFrame, universe: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """(firm_i, firm_j, year, count) of events (firm_i, firm_j, created_date, publication_year), i < j.

    Dates are UTC and both ends count; both firms must be of the universe; a year that is not its date's is an error.
    """
    e = events.withColumns({"firm_i": F.upper(F.trim("firm_i")), "firm_j": F.upper(F.trim("firm_j"))}).where(F.col("firm_i") != F.col("firm_j"))
    if start is not None:
        e = e.where(F.to_date("created_date") >= F.lit(start))
    if end is not None:
        e = e.where(F.to_date("created_date") <= F.lit(end))
    if universe is not None:
        for side in ("firm_i", "firm_j"):
            e = e.join(universe.select(F.upper("Symbol").alias(side)), side, "left_semi")
    require(e, year=none(F.year("created_date") != F.col("publication_year")))
    return e.groupBy(F.least("firm_i", "firm_j").alias("firm_i"), F.greatest("firm_i", "firm_j").alias("firm_j"), F.col("publication_year").alias("year")).agg(F.count(F.lit(1)).alias("count"))


def adjacency(pair_years: DataFrame, minimum_years: int = 1) -> DataFrame:
    """weight, n_years, first_year, last_year of each pair seen in at least minimum_years years."""
    return pair_years.groupBy("firm_i", "firm_j").agg(F.sum("count").alias("weight"), F.count(F.lit(1)).alias("n_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).where(F.col("n_years") >= minimum_years)


def mirrored(pairs: DataFrame, i: str = "firm_i", j: str = "firm_j", weight: str = "weight") -> DataFrame:
    """(target, candidate, weight) in both directions."""
    one = pairs.select(F.col(i).alias("target"), F.col(j).alias("candidate"), F.col(weight).cast("double").alias("weight"))
    return one.unionByName(one.select(F.col("candidate").alias("target"), F.col("target").alias("candidate"), "weight"))


def row_normalized(weights: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Weights over their target's sum. With a roster (target), edges outside it go and a target without edges is an error."""
    if roster is not None:
        weights = weights.join(roster, "target", "left_semi").join(roster.select(F.col("target").alias("candidate")), "candidate", "left_semi")
        if not roster.join(weights, "target", "left_anti").isEmpty():
            raise ContractError("a target has no edge")
    total = weights.groupBy("target").agg(F.sum("weight").alias("_s"))
    return weights.join(total, "target").select("target", "candidate", (F.col("weight") / F.col("_s")).alias("weight"))


def directional_mean(scores: DataFrame) -> DataFrame:
    """Mean score of each unordered pair over both directions and all years (gvkey1, gvkey2, year, score)."""
    kept = scores.where((F.col("gvkey1") != F.col("gvkey2")) & ~F.isnan("score") & F.col("score").isNotNull())
    return kept.groupBy(F.least("gvkey1", "gvkey2").alias("i"), F.greatest("gvkey1", "gvkey2").alias("j")).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def directed_years(scores: DataFrame) -> DataFrame:
    """Number of different years and mean score of each directed pair."""
    return scores.where(F.col("gvkey1") != F.col("gvkey2")).groupBy("gvkey1", "gvkey2").agg(F.count_distinct("year").alias("years"), F.avg("score").alias("score"))


MOST_FIRM_YEARS = 1 << 18


def complete_roster(years: DataFrame) -> list[int]:
    """Firms left when the one with the fewest years (smallest key on ties) goes until no pair has disjoint years.

    years: (gvkey1, year). One row for each firm reaches the driver: a roster, of at most MOST_FIRM_YEARS in all.
    """
    if years.select("gvkey1", "year").distinct().count() > MOST_FIRM_YEARS:
        raise ContractError(f"more than {MOST_FIRM_YEARS} firm years: not a roster")
    held = {r["gvkey1"]: set(r["y"]) for r in years.groupBy("gvkey1").agg(F.collect_set("year").alias("y")).collect()}
    while any(not held[a] & held[b] for a in held for b in held if a < b):
        del held[min(held, key=lambda k: (len(held[k]), k))]
    return sorted(held)


def dyads(*tables: DataFrame, key: tuple[str, str] = ("ticker_i", "ticker_j")) -> DataFrame:
    """Inner join of pair tables on their key, each unique; an empty result is an error."""
    out = unique(tables[0], *key)
    for t in tables[1:]:
        out = out.join(unique(t, *key), list(key))
    if out.isEmpty():
        raise ContractError("no dyad in common")
    return out


def with_endpoints(pairs: DataFrame, attributes: DataFrame, key: str, i: str = "ticker_i", j: str = "ticker_j") -> DataFrame:
    """attributes (key, ...) of both endpoints as columns <name>_i and <name>_j; missing stays null."""
    for side, end in ((i, "_i"), (j, "_j")):
        pairs = pairs.join(attributes.select(F.col(key).alias(side), *(F.col(c).alias(c + end) for c in attributes.columns if c != key)), side, "left")
    return pairs


def same(attribute: str) -> Column:
    """Whether both endpoints have the attribute and agree on it: a missing one never agrees."""
    return F.coalesce(F.col(attribute + "_i") == F.col(attribute + "_j"), F.lit(False))


def in_roster(pairs: DataFrame, roster: DataFrame, key: str, i: str = "ticker_i", j: str = "ticker_j") -> DataFrame:
    """Pairs both of whose ends are in the roster."""
    for side in (i, j):
        pairs = pairs.join(roster.select(F.col(key).alias(side)), side, "left_semi")
    return pairs


def latest_before(formations: DataFrame, vintages: DataFrame) -> DataFrame:
    """(formation, vintage): the latest vintage strictly before each formation; none is an error.

    Both sides are sorted once, in one stream by date, so there is no non-equi join.
    """
    both = formations.select(F.col("formation").alias("d"), F.lit(None).cast(vintages.schema["vintage"].dataType).alias("v"), F.lit(0).alias("side")).unionByName(vintages.select(F.col("vintage").alias("d"), F.col("vintage").alias("v"), F.lit(1).alias("side")))
    # a vintage of the same date comes after the formation, so it is not seen
    last = both.withColumn("vintage", F.last("v", ignorenulls=True).over(Window.partitionBy().orderBy("d", "side").rowsBetween(Window.unboundedPreceding, 0)))
    out = last.where("side = 0").select(F.col("d").alias("formation"), "vintage")
    require(out, found=none(F.col("vintage").isNull()))
    return out


def strict_tail(articles: DataFrame, news: DataFrame) -> DataFrame:
    """(target, readout): news summed over all articles dated strictly later, weighted by the articles' mass.

    articles (target, date, mass), news (target, date, value). Equal to a range join, by a running sum over one sorted
    stream for each target: the mass of later articles times the value.
    """
    a = articles.groupBy("target", "date").agg(F.sum("mass").alias("mass")).withColumn("value", F.lit(0.0))
    n = news.groupBy("target", "date").agg(F.sum("value").alias("value")).withColumn("mass", F.lit(0.0))
    day = a.unionByName(n).groupBy("target", "date").agg(F.sum("mass").alias("mass"), F.sum("value").alias("value"))
    later = F.sum("mass").over(Window.partitionBy("target").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1))
    return day.withColumn("later", F.coalesce(later, F.lit(0.0))).groupBy("target").agg(F.sum(F.col("later") * F.col("value")).alias("readout"))


def count_tails(counts: DataFrame, news: DataFrame) -> DataFrame:
    """(target, reference, readout): as strict_tail with counts normalised by target; null where target = reference.

    counts (target, date, n), news (reference, date, value).
    """
    total = counts.groupBy("target").agg(F.sum("n").alias("_s"))
    mass = counts.join(total, "target").select("target", "date", (F.col("n") / F.col("_s")).alias("mass"))
    # the mass of later dates, for every target at every date of the calendar: a running sum, then a join on the date
    calendar = news.select("date").distinct().join(total.select("target"), F.lit(True)).withColumn("mass", F.lit(0.0))
    day = mass.unionByName(calendar.select("target", "date", "mass")).groupBy("target", "date").agg(F.sum("mass").alias("mass"))
    later = F.sum("mass").over(Window.partitionBy("target").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1))
    seen = day.withColumn("later", later).where("later > 0").select("target", "date", "later")
    out = news.groupBy("reference", "date").agg(F.sum("value").alias("value")).join(seen, "date").groupBy("target", "reference").agg(F.sum(F.col("later") * F.col("value")).alias("readout"))
    return out.withColumn("readout", F.when(F.col("target") != F.col("reference"), F.col("readout")))


def sector_distances(pairs: DataFrame, sectors: DataFrame, value: str = "value") -> DataFrame:
    """(sector, within, cross, n_within, n_cross): mean distance of pairs with both ends, and with exactly one end, in a sector.

    pairs (ticker_i, ticker_j, value) once for each unordered pair; an end without a label is an error.
    """
    p = with_endpoints(pairs, sectors, "ticker")
    require(p, labelled=none(F.col("sector_i").isNull() | F.col("sector_j").isNull()))
    both = F.col("sector_i") == F.col("sector_j")
    ends = p.select(F.explode(F.when(both, F.array("sector_i")).otherwise(F.array("sector_i", "sector_j"))).alias("sector"), both.alias("b"), value)
    return ends.groupBy("sector").agg(F.avg(F.when(F.col("b"), F.col(value))).alias("within"), F.avg(F.when(~F.col("b"), F.col(value))).alias("cross"), F.count_if("b").alias("n_within"), F.count_if(~F.col("b")).alias("n_cross"))


def nearest_in_group(pairs: DataFrame, group: str, value: str = "value", i: str = "symbol1", j: str = "symbol2") -> DataFrame:
    """The closest pair of each group, ties by the names."""
    return top_k(pairs, [group], [value, i, j], 1).drop("rank")


def comparative_percentiles(pairs: DataFrame, value: str = "rms", i: str = "symbol1", j: str = "symbol2") -> DataFrame:
    """Rank and percentile of every pair, ordered by value and names."""
    n = pairs.count()
    placed = running_totals(pairs, [], [F.col(value), F.col(i), F.col(j)], {"_place": F.lit(1)})
    return placed.withColumns({"rank": F.col("_place") + 1, "percentile": F.when(F.lit(n > 1), 100.0 * F.col("_place") / max(n - 1, 1))}).drop("_place")


def neighbours(distances: DataFrame, k: int, i: str = "item_i", j: str = "item_j", value: str = "value") -> DataFrame:
    """The k nearest others of each item, ties by id."""
    return top_k(distances.where(F.col(i) != F.col(j)), [i], [value, j], k)


def neighbour_recall(first: DataFrame, second: DataFrame, k: int, i: str = "item_i", j: str = "item_j", value: str = "value") -> DataFrame:
    """(item, overlap, same_nearest): the share of common k nearest neighbours under two distances."""
    a = neighbours(first, k, i, j, value).select(i, j, F.col("rank").alias("ra"))
    b = neighbours(second, k, i, j, value).select(i, j, F.col("rank").alias("rb"))
    met = a.join(b, [i, j], "left")
    return met.groupBy(F.col(i).alias("item")).agg((F.count("rb") / F.lit(float(k))).alias("overlap"), (F.count_if((F.col("ra") == 1) & (F.col("rb") == 1)) > 0).alias("same_nearest"))


def strongest_partner(credits: DataFrame, i: str = "i", j: str = "j", value: str = "credit") -> DataFrame:
    """(i, partner, value): the largest partner (the first by id on ties); '' and 0 where none is positive."""
    best = credits.where(F.col(i) != F.col(j)).groupBy(i).agg(F.max(value).alias("v"), F.min_by(j, F.struct(-F.col(value), F.col(j))).alias("p"))
    return best.select(i, F.when(F.col("v") > 0, F.col("p")).otherwise("").alias("partner"), F.when(F.col("v") > 0, F.col("v")).otherwise(0.0).alias(value))


def pair_gaps(panel: DataFrame, pairs: DataFrame, value: str = "cumulative") -> DataFrame:
    """(symbol1, symbol2, rms, terminal): root mean square and last gap of two series on their common dates."""
    a = panel.select("Date", F.col("ticker").alias("symbol1"), F.col(value).alias("x"))
    b = panel.select("Date", F.col("ticker").alias("symbol2"), F.col(value).alias("y"))
    met = pairs.select("symbol1", "symbol2").distinct().where("symbol1 < symbol2").join(a, "symbol1").join(b, ["symbol2", "Date"])
    gap = F.col("x") - F.col("y")
    return met.groupBy("symbol1", "symbol2").agg(F.sqrt(F.avg(gap * gap)).alias("rms"), F.abs(F.max_by(gap, "Date")).alias("terminal"))


def link_statistics(pairs: DataFrame) -> DataFrame:
    """AUC of -distance for linked, rank correlation of distance with years linked, and the count of linked pairs."""
    from lodestrata.functions.ranks import auc, spearman

    # written down: a sum worked out again may end in other digits, and its row would then find no rank
    pairs = kept(pairs, "linked-pairs")
    s = pairs.withColumn("_s", -F.col("distance"))
    linked = pairs.agg(F.count_if(F.col("linked") == 1).alias("linked"), F.count(F.lit(1)).alias("pairs"))
    return auc(s, "_s", "linked").crossJoin(spearman(pairs, "distance", "years").select("spearman")).crossJoin(linked)


def rank_correlations(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """pearson and spearman of two columns over pairs."""
    held = kept(unique_pair(pairs, "item_i", "item_j"), "ranked-pairs")  # as in link_statistics
    r = average_ranks(average_ranks(held, x, "_x"), y, "_y")
    return r.agg(F.corr(x, y).alias("pearson"), F.corr("_x", "_y").alias("spearman"))


def set_overlap(first: DataFrame, second: DataFrame, by: str = "target", member: str = "candidate") -> DataFrame:
    """(by, common, either, jaccard, share_first): overlap of two supports of every target."""
    a, b = first.select(by, member).distinct().withColumn("_a", F.lit(1)), second.select(by, member).distinct().withColumn("_b", F.lit(1))
    met = a.join(b, [by, member], "full")
    common, either = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()), F.count(F.lit(1))
    return met.groupBy(by).agg(common.alias("common"), either.alias("either"), (common / either).alias("jaccard"), (common / F.nullif(F.count("_a"), F.lit(0))).alias("share_first"))
