"""Near-duplicates of embeddings: spherical k-means cells, blocked cosine products within cells.

Equal vectors are one vector with a multiplicity. Centroids are fitted on a sample of at most
about SAMPLE_FLOATS components and thinned until no two are closer
than MERGE, so that a crowd of near-copies has one cell rather than many overlapping ones. Every vector lives in the cell of
its nearest centroid and also visits each cell whose boundary is nearer than a margin. If x lives in a and y in b, their
distances beyond the boundary of a and b add up to at most |x - y|, so at least one of the two visits the other's cell
whenever |x - y| is at most twice the margin. Vectors at the threshold are sqrt(2 - 2 * threshold) apart, so half of that (0.158 at
0.95) loses no link, whatever the vectors: the search is exact.

Vectors within half the threshold's angle of their centroid (the core) are all linked with one another by the triangle
inequality, so a cell's core counts as a whole and is never compared with itself. The rest of a cell is compared in blocks
of ROW_BLOCK x COLUMN_BLOCK, each a task of its own; a block returns counts and a spanning forest of its links, never pairs.

Defined cases: a vector that is null, all zero, or has a null or non-finite component links with nothing, as do vectors of
different lengths; rows with equal ids count as vectors of their own; component_id is the smallest id that is not null; further
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, table
from lodestrata.llm.graph import components

THRESHOLD, MERGE = 0.95, 0.7
CELL_VECTORS, MAX_CELLS, SAMPLE_PER_CELL, SAMPLE_FLOATS, ROUNDS = 400, 8192, 32, 1 << 23, 8
ROW_BLOCK, COLUMN_BLOCK = 1024, 4096


def exact_margin(threshold: float) -> float:
    """Half the distance of vectors at the threshold, and a little for rounding."""
    return math.sqrt(2 - 2 * threshold) / 2 + 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1 (scaled by the largest component first, against overflow)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows, none closer than MERGE to a larger one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        n = np.linalg.norm(total, axis=1)
        c = np.where(n[:, None] > 1e-9, total / np.maximum(n, 1e-9)[:, None], c)
    order = np.argsort(-np.bincount(nearest(x, c), minlength=len(c)), kind="stable")
    kept: list[int] = []
    for i in order:
        if not kept or (c[kept] @ c[i]).max() < MERGE:
            kept.append(i)
    return c[kept]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])


def visits(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and whether it visits each cell."""
    s = x @ c.T
    home = s.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))
    seen = (s[np.arange(len(x)), home][:, None] - s) / gap[home] <= margin
    seen[np.arange(len(x)), home] = False
    return home, seen


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def fit(vectors: DataFrame, n: int, dim: int) -> np.ndarray:
    k = int(min(max(1, n // CELL_VECTORS), MAX_CELLS))
    rate = min(1.0, min(k * SAMPLE_PER_CELL, max(k, SAMPLE_FLOATS // dim)) / max(n, 1))
    sample = vectors.where(F.pmod(F.xxhash64("rep", F.lit("fit")), F.lit(1_000_000)) < rate * 1e6)
    t = sample.select("rep", "embedding").toArrow()
    if not len(t):
        t = vectors.orderBy("rep").limit(1).select("rep", "embedding").toArrow()
    x = unit(matrix(t.column("embedding"), dim))[np.argsort(t.column("rep").to_numpy(), kind="stable")]
    return kmeans(x, k)


PLACED = "cell int, home int, core boolean, visits array<int>, rep long, mult long, unit binary"


def place(vectors: DataFrame, c: np.ndarray, threshold: float, margin: float) -> DataFrame:
    """Each vector in its home cell and in those that it visits."""
    held = vectors.sparkSession.sparkContext.broadcast(c)
    half = math.cos(math.acos(threshold) / 2 - 1e-7)

    def assign(batches):
        c = held.value
        for batch in batches:
            x = unit(matrix(batch.column("embedding"), c.shape[1]))
            for lo in range(0, len(x), 2048):
                y = x[lo : lo + 2048]
                home, seen = visits(y, c, margin)
                row, cell = np.nonzero(seen)
                lists = np.split(cell.astype(np.int32), np.cumsum(seen.sum(axis=1))[:-1])
                core = (y * c[home]).sum(axis=1) >= half
                at = np.concatenate([np.arange(len(y)), row])
                away = np.arange(len(at)) >= len(y)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(home[at].astype(np.int32)), pa.array(core[at] & ~away), pa.array([lists[i] if not v else None for i, v in zip(at, away, strict=True)], pa.list_(pa.int32())),
                    batch.column("rep")[lo : lo + 2048].take(pa.array(at)), batch.column("mult")[lo : lo + 2048].take(pa.array(at)), pa.array([y[i].tobytes() for i in at], pa.binary()),
                ], ["cell", "home", "core", "visits", "rep", "mult", "unit"])

    return vectors.select("rep", "mult", "embedding").mapInArrow(assign, PLACED)


def compare(threshold: float):
    """The function of one block: (rep, links, root) for its rows, for core columns, and edges of a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(r) or not len(c):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        X, Y = (np.frombuffer(b"".join(p["unit"]), np.float64).reshape(len(p), -1) for p in (r, c))
        cell = int(r["cell"].iloc[0])
        a, b = r["rep"].to_numpy(), c["rep"].to_numpy()
        ok = (X @ Y.T >= threshold) & (a[:, None] != b[None, :])
        r_home, c_home = r["home"].to_numpy(), c["home"].to_numpy()
        # a visitor and a resident who visit each other's cells meet in the lower one
        for homes, other, turn in ((r_home, c, False), (c_home, r, True)):
            met_any = ok.any(axis=0 if turn else 1)
            for h in np.unique(homes[(homes < cell) & met_any]):
                met = np.array([v is not None and h in v for v in other["visits"]])
                if turn:
                    ok &= ~(met[:, None] & (homes == h)[None, :])
                else:
                    ok &= ~((homes == h)[:, None] & met[None, :])
        # residents outside the core are rows and columns; all others only count as columns, or against the core
        mult_r, mult_c, core = r["mult"].to_numpy(), c["mult"].to_numpy(), c["core"].to_numpy()
        r_lives, c_lives = r_home == cell, (c_home == cell) & ~core
        ok[np.ix_(~r_lives, ~core)] = False
        out = [(a, ok @ mult_c, a), (b[~c_lives], mult_r @ ok[:, ~c_lives], b[~c_lives])]
        if ok.any():
            label_r, label_c = a.copy(), b.copy()
            big = np.iinfo(np.int64).max
            while True:
                new_r = np.minimum(label_r, np.where(ok, label_c[None, :], big).min(axis=1))
                new_c = np.minimum(label_c, np.where(ok, new_r[:, None], big).min(axis=0))
                if (new_r == label_r).all() and (new_c == label_c).all():
                    break
                label_r, label_c = new_r, new_c
            out += [(x, np.zeros(len(x), np.int64), y) for x, y in ((a, label_r), (b, label_c))]
        rep, links, root = (np.concatenate(z).astype(np.int64) for z in zip(*out, strict=True))
        keep = (links > 0) | (root != rep)
        return pd.DataFrame({"rep": rep[keep], "links": links[keep], "root": root[keep]})

    return run


def blocks(placed: DataFrame) -> DataFrame:
    """Rows and columns of each cell, dealt to blocks (cell, i, j). Rows: residents outside the core, and visitors if there is a core."""
    # one row for each cell: MAX_CELLS bounds the broadcast
    lives = F.col("home") == F.col("cell")
    sizes = placed.groupBy("cell").agg(F.count(F.when(lives & ~F.col("core"), 1)).alias("residents"), F.count(F.when(F.col("core"), 1)).alias("cores"), F.count("*").alias("all"))
    turns = F.col("residents") + F.when(F.col("cores") > 0, F.col("all") - F.col("residents") - F.col("cores")).otherwise(0)
    sizes = sizes.select("cell", "cores", F.ceil(turns / ROW_BLOCK).cast("int").alias("ni"), F.ceil(F.col("all") / COLUMN_BLOCK).cast("int").alias("nj"))
    both = placed.join(F.broadcast(sizes), "cell")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    some = both.where("ni > 0")
    rows = some.where(~F.col("core") & (lives | (F.col("cores") > 0))).withColumn("i", mine("ni", "row")).withColumn("j", upto("nj")).withColumn("side", F.lit(0))
    columns = some.withColumn("j", mine("nj", "column")).withColumn("i", upto("ni")).withColumn("side", F.lit(1))
    return rows.select("side", "i", "j", *placed.columns).unionByName(columns.select("side", "i", "j", *placed.columns))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding); with no margin given, the exact one."""
    margin = exact_margin(threshold) if margin is None else margin
    spark = vectors.sparkSession
    rows = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "vectors")
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.coalesce(fine, F.lit(False)))
    groups = materialize(valid.groupBy("embedding").agg(F.min("row").alias("rep"), F.count("*").alias("mult")), "distinct")
    member = materialize(valid.join(groups, "embedding").select("row", "rep", "mult"), "members")
    links = edges = None
    for dim, n in groups.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect():
        same = groups.where(F.size("embedding") == dim)
        placed = materialize(place(same, fit(same, n, dim), threshold, margin), "placed")
        found = materialize(blocks(placed).groupBy("cell", "i", "j").applyInPandas(compare(threshold), "rep long, links long, root long"), "found")
        core = placed.where("core")
        whole = F.broadcast(core.groupBy("cell").agg(F.sum("mult").alias("all"), F.min("rep").alias("root")))
        core = core.join(whole, "cell").select("rep", (F.col("all") - F.col("mult")).alias("links"), "root")
        both = found.unionByName(core)
        links = both if links is None else links.unionByName(both)
    if links is None:
        links = spark.createDataFrame([], "rep long, links long, root long")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = links.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    roots = components(edges)
    reps = groups.select("rep").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    labelled = materialize(rows.select("row", "vec_id").join(member.join(reps, "rep"), "row", "left"), "labelled")
    smallest = labelled.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = labelled.join(smallest, "root", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), low AS (SELECT x, min(y) AS m FROM reach GROUP BY x), n AS (SELECT x, count(*) AS c FROM link GROUP BY x)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
