"""Bootstrap schedules as tables and draws as tasks: every draw is seeded by its own key, so a lost task gives the same draw again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stationary_indices(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """Positions of one stationary bootstrap path: circular blocks of geometric length, `block` on average."""
    fresh = rng.random(n) < 1 / block
    fresh[0] = True
    starts = rng.integers(0, n, n)
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (starts[last] + np.arange(n) - last) % n


def index_table(spark: SparkSession, n: int, draws: int, block: float, seed: int, assets: list[str] | None = None, tasks: int = 64) -> DataFrame:
    """(draw, position, source), or with assets (draw, asset, position, source) with a path of its own for each asset."""

    def run(batches):
        for pdf in batches:
            for d in pdf["draw"]:
                if assets is None:
                    idx = stationary_indices(n, block, np.random.default_rng([seed, int(d)]))
                    yield pd.DataFrame({"draw": int(d), "position": np.arange(n), "source": idx})
                else:
                    for k, a in enumerate(assets):
                        idx = stationary_indices(n, block, np.random.default_rng([seed + k, int(d)]))
                        yield pd.DataFrame({"draw": int(d), "asset": a, "position": np.arange(n), "source": idx})

    ddl = "draw long, position long, source long" if assets is None else "draw long, asset string, position long, source long"
    return spark.range(draws).select(F.col("id").alias("draw")).repartition(max(1, min(tasks, draws)), "draw").mapInPandas(run, ddl)


def paired_schedules(spark: SparkSession, calibration: int, evaluation: int, draws: int, block: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Schedules of two samples with seeds apart, for refits that pair a draw of one with the same draw of the other."""
    return index_table(spark, calibration, draws, block, seed), index_table(spark, evaluation, draws, block, seed + 1)


def resampled(panel: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows of (position, ...) for each draw's sources: (draw, position, ...)."""
    values = panel.withColumnRenamed("position", "source")
    return indices.join(values, "source").drop("source")


def node_counts(spark: SparkSession, nodes: list[str], draws: int, seed: int) -> DataFrame:
    """(draw_id, ticker, multiplicity): multinomial node draws; a node drawn zero times has a row."""

    def run(batches):
        for pdf in batches:
            for d in pdf["draw"]:
                m = np.random.default_rng([seed, int(d)]).multinomial(len(nodes), np.full(len(nodes), 1 / len(nodes)))
                yield pd.DataFrame({"draw_id": int(d), "ticker": nodes, "multiplicity": m})

    return spark.range(draws).select(F.col("id").alias("draw")).repartition(max(1, min(64, draws)), "draw").mapInPandas(run, "draw_id long, ticker string, multiplicity long")


def dyad_weights(dyads: DataFrame, counts: DataFrame, i: str = "item_i", j: str = "item_j") -> DataFrame:
    """Each dyad in each draw with weight w_i w_j; dyads of weight zero go."""
    a = counts.select("draw_id", F.col("ticker").alias(i), F.col("multiplicity").alias("_a")).where("_a > 0")
    b = counts.select("draw_id", F.col("ticker").alias(j), F.col("multiplicity").alias("_b")).where("_b > 0")
    return dyads.join(a, i).join(b, ["draw_id", j]).withColumn("weight", (F.col("_a") * F.col("_b")).cast("double")).drop("_a", "_b")


def bootstrap_slopes(dyads: DataFrame, counts: DataFrame, y: str, x: str) -> DataFrame:
    """(draw_id, slope): the weighted slope of each node draw, by one aggregation over (dyad, draw)."""
    w = dyad_weights(dyads, counts)
    s = lambda e: F.sum(F.col("weight") * e)
    one, fx, fy = F.lit(1.0), F.col(x), F.col(y)
    g = w.groupBy("draw_id").agg(s(one).alias("n"), s(fx).alias("sx"), s(fy).alias("sy"), s(fx * fx).alias("sxx"), s(fx * fy).alias("sxy"))
    return g.select("draw_id", ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.nullif(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.lit(0.0))).alias("slope"))


def replicate(spark: SparkSession, keys: DataFrame, task: Callable[[dict], dict], ddl: str, done: DataFrame | None = None) -> DataFrame:
    """task of every key row that is not done yet, spread over tasks; write the result keyed by its columns to resume from it."""
    names = keys.columns
    todo = keys if done is None else keys.join(done.select(names), names, "left_anti")

    def run(batches):
        for pdf in batches:
            rows = [task(r) for r in pdf.to_dict("records")]
            if rows:
                yield pd.DataFrame(rows)

    return todo.repartition(*names).mapInPandas(run, ddl)


def stratified_masses(counts: DataFrame, seed: int, draws: int) -> DataFrame:
    """(draw, stratum, atom, mass): multinomial redraws within each stratum of (stratum, atom, n), normalised over the strata's total."""
    kind = counts.schema["atom"].dataType.simpleString()
    packed = counts.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("atom", "n"))).alias("rows"))
    total = counts.agg(F.sum("n")).first()[0]
    grid = packed.join(F.broadcast(counts.sparkSession.range(draws).toDF("draw")), F.lit(True))

    def run(batches):
        for pdf in batches:
            for d, s, rows in zip(pdf["draw"], pdf["stratum"], pdf["rows"], strict=True):
                n = np.array([r["n"] for r in rows], float)
                m = np.random.default_rng([seed, int(d), int.from_bytes(str(s).encode()[:8].ljust(8, b"\0"), "big")]).multinomial(int(n.sum()), n / n.sum())
                yield pd.DataFrame({"draw": int(d), "stratum": s, "atom": [r["atom"] for r in rows], "mass": m / total})

    return grid.mapInPandas(run, f"draw long, stratum string, atom {kind}, mass double")


def nested_archive(archive: np.ndarray, history: int, outer: int, inner: int, seed: int) -> np.ndarray:
    """Counts (dates x atoms) redrawn twice: dates in the outer draw, atoms within each date in the inner one."""
    dates, atoms = archive.shape
    pick = np.random.default_rng([seed, history, outer]).multinomial(dates, np.full(dates, 1 / dates))
    out = np.zeros_like(archive)
    for d in np.flatnonzero(pick):
        n = archive[d].sum()
        if n:
            rng = np.random.default_rng([seed, history, outer, inner + 1, d])
            out[d] = rng.multinomial(int(n) * int(pick[d]), archive[d] / n)
    return out


def outer_inner(spark: SparkSession, archives: dict[int, np.ndarray], outer: int, inner: int, seed: int, statistic: Callable[[np.ndarray], float]) -> DataFrame:
    """(history, outer, estimate, se, draws): the statistic of each outer redraw of a history, and the spread of its inner redraws.

    archives: counts (dates x atoms) of each history. A task holds one (history, outer) and runs its inner redraws, so a lost one
    costs those alone; the statistic is null where it is not finite, and se where fewer than two inner ones are.
    """
    held = spark.sparkContext.broadcast(archives)

    def run(batches):
        for pdf in batches:
            rows = []
            for h, o in zip(pdf["history"], pdf["outer"], strict=True):
                values = [statistic(nested_archive(held.value[int(h)], int(h), int(o), k, seed)) for k in range(inner + 1)]
                finite = [v for v in values[1:] if np.isfinite(v)]
                rows.append((int(h), int(o), values[0] if np.isfinite(values[0]) else None, float(np.std(finite, ddof=1)) if len(finite) > 1 else None, len(finite)))
            yield pd.DataFrame(rows, columns=["history", "outer", "estimate", "se", "draws"])

    keys = spark.createDataFrame([(h,) for h in sorted(archives)], "history int").crossJoin(spark.range(outer).select(F.col("id").cast("int").alias("outer")))
    return keys.repartition(max(1, min(200, outer * len(archives))), "history", "outer").mapInPandas(run, "history int, outer int, estimate double, se double, draws long")


def article_panels(laws: DataFrame, counts: DataFrame, redraws: int, budgets: list[int], seed: int) -> DataFrame:
    """(history, redraw, budget, date, atom, n): multinomial articles of each dated law, for each budget times the date's count.

    laws (history, date, atom, mass), counts (date, n). One (history, date) is a task's unit; an atom that is not drawn has no row.
    """
    packed = laws.groupBy("history", "date").agg(F.array_sort(F.collect_list(F.struct("atom", "mass"))).alias("law")).join(counts.select("date", F.col("n").alias("articles")), "date")
    grid = packed.withColumn("redraw", F.explode(F.sequence(F.lit(0), F.lit(redraws - 1)))).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))

    def run(batches):
        for pdf in batches:
            rows = []
            for h, d, law, n, k, b in zip(*(pdf[c] for c in ("history", "date", "law", "articles", "redraw", "budget")), strict=True):
                p = np.array([r["mass"] for r in law], float)
                drawn = np.random.default_rng([seed, int(h), int(k), int(b), int(d)]).multinomial(int(n) * int(b), p / p.sum())
                rows += [(int(h), int(k), int(b), int(d), law[i]["atom"], int(drawn[i])) for i in np.flatnonzero(drawn)]
            yield pd.DataFrame(rows, columns=["history", "redraw", "budget", "date", "atom", "n"])

    kind = laws.schema["atom"].dataType.simpleString()
    return grid.mapInPandas(run, f"history int, redraw int, budget int, date int, atom {kind}, n long")


def quantile_band(draws: DataFrame, value: str, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Count, mean and exact quantile band of finite draws."""
    from lodestrata.functions.ranks import linear_quantiles

    t = (1 - confidence) / 2
    q = linear_quantiles(value, [t, 1 - t])
    return draws.groupBy(*by).agg(F.count_if(~F.isnan(value)).alias("n"), F.avg(F.when(~F.isnan(value), F.col(value))).alias("mean"), q[0].alias("low"), q[1].alias("high"))
