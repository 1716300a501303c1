"""Hard negatives of embeddings: exact inner-product search over k-means inverted lists with stored radii.

Components become integers, so scores are exact and ties are ties. Centroids are fitted on a sample of at most SAMPLE_FLOATS
components; every row is then put into the list of its nearest centroid, and the largest distance in a list is stored as its
radius. By Cauchy-Schwarz an anchor q scores at most q.c + |q| r, and at least q.c - |q| r, with any row of a list. Each
target (an anchor for its positives, an anchor and a positive for its negatives) visits lists in order of that bound, in
waves of FIRST lists, then GROWTH times as many; a list whose range lies outside the target's window is skipped, and a target
stops when the bound falls strictly below its k-th score, since an equal score may still win by a smaller id. Waves end when no
target visits anything, so the search is exact whatever the data, only the number of visits depends on them.

Lists are cut into parts of about LIST_ROWS rows, each with its vectors in one value; anchors travel to the parts (a few
kilobytes), the parts never to the anchors. Each visit returns at most k rows for a target, and the best of all visits are
taken by a window whose limit Spark applies before it shuffles. Centroids, radii and sizes are at most MAX_CELLS rows.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part, nor do they take part
for vectors of another length; a null vec_id is no anchor, changes no label and loses all ties; rows with one vec_id are rows of their own,
each an anchor where the id is one; a negative label stays as SQL's remainder has it; scores have to fit a long, and a table
with components beyond that is refused; further columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import forget, last_only, materialize, merge, table

ANCHORS, MOVED, LABELS, POSITIVES, NEGATIVES, SCALE = 50, 7, 10, 5, 3, 256
LIST_ROWS, MAX_CELLS, SAMPLE_PER_CELL, SAMPLE_FLOATS, ROUNDS = 4096, 8192, 64, 1 << 22, 6
FIRST, GROWTH, CHUNK = 4, 8, 256
LEAST, MOST = -(1 << 62), 1 << 62


def pack_ints(x: np.ndarray) -> bytes:
    """Integers in two bytes each where all of them fit, else in eight."""
    return x.astype("<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i8").tobytes()


def unpack_ints(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * n * dim else "<i8").reshape(n, dim).astype(np.int64)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, by floats where these are exact."""
    top = float(np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0)))
    if top < 1 << 52:
        return np.rint(a.astype(float) @ x.astype(float).T).astype(np.int64)
    if top < (1 << 62) * 0.99:
        return a @ x.T
    raise ArithmeticError("inner products do not fit a long")


def lloyd(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Centroids of rows."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        home = closest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        n = np.bincount(home, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 2048] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


class Cells:
    """Centroids with the radius and the number of parts of their lists."""

    def __init__(self, centroids: np.ndarray, radius: np.ndarray, parts: np.ndarray):
        self.centroids, self.radius, self.parts = centroids, radius, parts
        self.norm = np.linalg.norm(centroids, axis=1)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Middle, least and largest score of each row of q with any row of each list; a little wider, for rounding."""
        length = np.linalg.norm(q, axis=1)[:, None]
        middle = q @ self.centroids.T
        reach = length * self.radius + 1e-9 * length * (self.norm + self.radius) + 1e-6
        return middle, middle - reach, middle + reach

    def visits(self, q: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int, last: int) -> np.ndarray:
        """Whether each target visits each list in the wave of places first to last of its order."""
        middle, least, largest = (b[at] for b in self.bounds(q))
        best = np.minimum(largest, hi[:, None])
        order = np.lexsort((np.abs(middle - hi[:, None]), -best), axis=1)[:, first:last]
        out = np.zeros(best.shape, bool)
        np.put_along_axis(out, order, True, axis=1)
        return out & (best >= lo[:, None]) & (least <= hi[:, None]) & (self.parts > 0)


def points(vectors: DataFrame) -> DataFrame:
    """row, id, label, dim, vec of the rows that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(F.coalesce(F.col("vec_id") % MOVED == 0, F.lit(False)), (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))

    def whole(batches):
        for batch in batches:
            out = []
            for v in batch.column("x"):
                v = np.floor(SCALE * np.asarray(v.values, np.float64))
                if v.size and np.abs(v).max() >= 1 << 61:
                    raise ArithmeticError("inner products do not fit a long")
                out.append(pack_ints(v.astype(np.int64)))
            sizes = np.diff(batch.column("x").offsets.to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), pa.array(sizes), pa.array(out, pa.binary())], names=["row", "id", "label", "dim", "vec"])

    return rows.mapInArrow(whole, "row long, id long, label long, dim int, vec binary")


LIST = "cell int, part int, vecs binary, ids array<long>, rows array<long>, labels array<long>"


def index(rows: DataFrame, n: int, dim: int) -> tuple[Cells, DataFrame]:
    """Cells, and the parts of their lists with rows in order of id."""
    spark = rows.sparkSession
    k = int(min(max(1, n**0.5 / 4), MAX_CELLS))
    rate = min(1.0, min(k * SAMPLE_PER_CELL, max(k, SAMPLE_FLOATS // max(dim, 1))) / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("row", F.lit("fit")), F.lit(1_000_000)) < rate * 1e6).select("row", "vec").toArrow()
    if not len(sample):
        sample = rows.orderBy("row").limit(1).select("row", "vec").toArrow()
    x = np.stack([unpack_ints(v, 1, dim)[0] for v in sample.sort_by("row").column("vec").to_pylist()]).astype(float)
    held = spark.sparkContext.broadcast(lloyd(x, k))

    def assign(batches):
        c = held.value
        for batch in batches:
            x = np.stack([unpack_ints(v.as_py(), 1, dim)[0] for v in batch.column("vec")]).astype(float) if batch.num_rows else np.zeros((0, dim))
            home = closest(x, c)
            far = np.linalg.norm(x - c[home], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    homes = materialize(rows.select("row", "id", "label", "vec").mapInArrow(assign, "row long, id long, label long, vec binary, cell int, far double"), "homes")
    sizes = homes.groupBy("cell").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"), F.max("far").alias("radius"))
    c = held.value
    radius, parts = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for r in sizes.collect():  # at most MAX_CELLS
        radius[r.cell], parts[r.cell] = r.radius * (1 + 1e-9) + 1e-6, r.parts

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id").combine_chunks()  # nulls last
        own = np.stack([unpack_ints(v, 1, dim)[0] for v in group.column("vec").to_pylist()])
        columns = [[group.column("cell")[0].as_py()], [group.column("part")[0].as_py()], [pack_ints(own)], *([group.column(n).to_pylist()] for n in ("id", "row", "label"))]
        types = [pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        return pa.table([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["cell", "part", "vecs", "ids", "rows", "labels"])

    dealt = homes.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    lists = materialize(dealt.groupBy("cell", "part").applyInArrow(pack, LIST), "lists")
    forget(homes)
    return Cells(c, radius, parts), lists


ANCHOR = "block long, vecs binary, ids array<long>, rows array<long>, labels array<long>"


def anchors_of(lists: DataFrame, dim: int) -> DataFrame:
    """The anchors of each part, as a block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = [i for i, v in enumerate(row["ids"]) if v is not None and v % ANCHORS == 0]
                if own:
                    vecs = unpack_ints(row["vecs"], len(row["ids"]), dim)[own]
                    columns = [[(row["cell"] << 32) | row["part"]], [pack_ints(vecs)], *([[row[n][i] for i in own]] for n in ("ids", "rows", "labels"))]
                    types = [pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["block", "vecs", "ids", "rows", "labels"])

    return materialize(lists.mapInArrow(run, ANCHOR), "anchors")


VISIT = [("cell", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("q", pa.binary()), ("q_rows", pa.list_(pa.int64())), ("q_labels", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("target", pa.list_(pa.int32())), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))]
VISITS = "cell int, part int, block long, q binary, q_rows array<long>, q_labels array<long>, at array<int>, target array<int>, lo array<long>, hi array<long>"


def plan(cells, dim: int, first: int, last: int):
    """Blocks of anchors with their targets to the visits of one wave, a row for each part of a list."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = cells.value
        for batch in batches:
            for row in batch.to_pylist():
                q = unpack_ints(row["vecs"], len(row["rows"]), dim)
                goals = sorted(row["goals"], key=lambda g: g["target"])
                for k in range(0, len(goals), CHUNK):
                    some = goals[k : k + CHUNK]
                    at, target, lo, hi = (np.array([g[n] for g in some], np.int64) for n in ("at", "target", "lo", "hi"))
                    seen = own.visits(q.astype(float), at, lo, hi, first, last)
                    out = []
                    for cell in np.flatnonzero(seen.any(axis=0)):
                        who = np.flatnonzero(seen[:, cell])
                        used, place = np.unique(at[who], return_inverse=True)
                        shared = [int(cell), None, row["block"], pack_ints(q[used]), [row["rows"][i] for i in used], [row["labels"][i] for i in used], place.tolist(), target[who].tolist(), lo[who].tolist(), hi[who].tolist()]
                        out += [[shared[0], part, *shared[2:]] for part in range(own.parts[cell])]
                    for j in range(0, len(out), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out[j : j + 64], strict=True), VISIT, strict=True)], names=[n for n, _ in VISIT])

    return run


def best_of(q: np.ndarray, x: np.ndarray, allowed: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, column, score) of the k best columns of each target within its window; the first of equal ones leads."""
    s = products(q, x)
    low = np.iinfo(np.int64).min
    m = np.where(allowed, s, low)[at]
    m[(m < lo[:, None]) | (m > hi[:, None])] = low
    found, every = [], np.arange(len(at))
    for _ in range(min(k, m.shape[1])):
        j = m.argmax(axis=1)
        score = m[every, j]
        some = np.flatnonzero(score > low)
        if not len(some):
            break
        found.append((some, j[some], score[some]))
        m[some, j[some]] = low
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def look(dim: int, same: bool, k: int):
    """Visits joined with their parts, to the best rows of each target."""
    names = ["block", "target", "score", "id"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                q, x = unpack_ints(r["q"], len(r["q_rows"]), dim), unpack_ints(r["vecs"], len(r["ids"]), dim)
                at, target, lo, hi = (np.array(r[n], np.int64) for n in ("at", "target", "lo", "hi"))
                allowed = (np.array(r["q_labels"])[:, None] == np.array(r["labels"])[None, :]) == same
                if same:
                    allowed &= np.array(r["q_rows"])[:, None] != np.array(r["rows"])[None, :]
                t, j, score = best_of(q, x, allowed, at, lo, hi, k)
                if len(t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), r["block"])), pa.array(target[t].astype(np.int32)), pa.array(score), pa.array([r["ids"][c] for c in j], pa.int64())], names=names)

    return run


def search(anchors: DataFrame, lists: DataFrame, cells: Cells, dim: int, goals: DataFrame, same: bool, k: int) -> DataFrame:
    """block, target, score, id, rank of the k best rows of each target. goals: block, target, at (anchor's place), lo, hi."""
    spark = anchors.sparkSession
    held = spark.sparkContext.broadcast(cells)
    order = Window.partitionBy("block", "target").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    best, first, last = None, 0, FIRST
    while first < len(cells.radius):
        now = goals
        if best is not None:
            kth = best.where(F.col("rank") == k).select("block", "target", F.col("score").alias("kth"))
            now = goals.join(merge(kth), ["block", "target"], "left").withColumn("lo", F.greatest("lo", "kth"))
        grouped = now.groupBy("block").agg(F.collect_list(F.struct("target", "at", "lo", "hi")).alias("goals"))  # targets of one part's anchors
        visits = materialize(merge(anchors).join(grouped, "block").mapInArrow(plan(held, dim, first, last), VISITS), "visits")
        if visits.isEmpty():
            break
        found = merge(visits).join(lists, ["cell", "part"]).drop("cell", "part").mapInArrow(look(dim, same, k), "block long, target int, score long, id long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        after = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        forget(visits)
        if best is not None:
            forget(best)
        best, first, last = after, last, last * GROWTH
    return best if best is not None else spark.createDataFrame([], "block long, target int, score long, id long, rank int")


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label)."""
    rows = materialize(points(vectors), "points")
    out = None
    for dim, n in rows.groupBy("dim").count().orderBy("dim").collect():
        cells, lists = index(rows.where(F.col("dim") == dim), n, dim)
        anchors = anchors_of(lists, dim)
        each = anchors.select("block", F.posexplode("ids").alias("at", "anchor_id"))
        whole = each.select("block", F.col("at").alias("target"), "at", F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
        positives = search(anchors, lists, cells, dim, whole, True, POSITIVES).withColumnRenamed("target", "at")
        positives = positives.withColumn("target", F.col("at") * POSITIVES + F.col("rank") - 1).drop("rank").withColumnsRenamed({"score": "positive_score", "id": "positive_id"})
        # 50 p <= 100 n <= 95 p in integers: n from the half rounded up to p less a twentieth rounded up; none where p is negative
        lo, hi = F.expr("positive_score div 2 + positive_score % 2"), F.expr("positive_score - positive_score div 20 - if(positive_score % 20 > 0, 1, 0)")
        windows = positives.select("block", "target", "at", "positive_score", lo.alias("lo"), hi.alias("hi")).where("positive_score >= 0 and lo <= hi").drop("positive_score")
        negatives = search(anchors, lists, cells, dim, windows, False, NEGATIVES).withColumnsRenamed({"score": "negative_score", "id": "negative_id"})
        found = merge(negatives).join(positives, ["block", "target"]).join(each, ["block", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_only(spark, lambda: hard_negatives(table(spark, sf_dir, "embeddings")), "negatives")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), p AS (
  SELECT ar, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other) AS pr FROM s WHERE same QUALIFY pr <= 5
), n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score QUALIFY rank <= 3
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n
"""
