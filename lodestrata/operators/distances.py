"""Distances between clouds of vectors.

A cloud is the rows of one item: (item, key, v). The point-pair means behind energy and MMD distances are sums over pairs of
rows, so they are computed in blocks: rows are dealt to blocks of about BLOCK_BYTES, each packed into one row, every pair of blocks
meets once, tile by tile, and NumPy products give the partial sums, which Spark adds up. A plain DataFrame form of the same sums (pair_means_sql) serves small
clouds and as a check.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import arrays as A
from lodestrata.functions.ranks import top_k
from lodestrata.operators.transport import balanced_assignment
from lodestrata.shared import kept
from lodestrata.sources.contracts import none, require, unique

#: A block of points; smaller where there would be fewer than LEAST_BLOCKS of them, so that a small problem has several tasks.
BLOCK_BYTES, LEAST_BLOCKS = 1 << 21, 6
#: Beyond MANY_BLOCKS of them blocks grow, to GROWN times that size: what is shuffled is the points times the number of blocks.
MANY_BLOCKS, GROWN = 16, 8
#: Points in a block at most, whatever the width; blocks of clouds of more than FEW_ITEMS items do not grow, as their sums have a cell for each pair of items.
BLOCK_POINTS, FEW_ITEMS = 1 << 15, 1 << 10
#: Bytes of the pairs of blocks in one task at most; tasks for each core, where there are as many pairs.
TASK_BYTES, TASKS_OF_CORE = 1 << 28, 32
#: Differences that are held at once: 8 MB of doubles, whatever the width.
DIFFERENCES = 1 << 20
#: Rows of a batch of distances between queries and rows.
BATCH_ROWS = 1 << 16
#: Pairs of a query and a row whose distances are held and sorted at once: 128 MB of distances, of cosines and of places.
PAIRS_HELD = 1 << 24
#: Points of the two sides of a tile: 384 KB of doubles, which stay in a core's cache.
TILE = (128, 384)
#: Squared distances below this share of a point's squared length are taken from differences, the others from products.
CLOSE = 1e-3


def first_rows(clouds: DataFrame, m: int) -> DataFrame:
    """The first m rows of each item by key."""
    return top_k(clouds, ["item"], ["key"], m).drop("rank")


def representation(clouds: DataFrame, width: int | None = None, unit_rows: bool = True) -> DataFrame:
    """Leading coordinates, then unit rows."""
    v = A.doubles("v") if width is None else A.prefix(A.doubles("v"), width)
    return clouds.withColumn("v", A.unit(v) if unit_rows else v)


def cloud_contract(clouds: DataFrame, width: int | None = None, unit_rows: bool = False, tolerance: float = 1e-5) -> DataFrame:
    """clouds, if keys are unique within items, all vectors have one width and finite elements, and unit length if asked."""
    unique(clouds, "item", "key")
    d = F.size("v")
    checks = {"width": (F.min(d) == F.max(d)) if width is None else none(d != width), "finite": none(~A.all_finite("v"))}
    if unit_rows:
        checks["unit"] = none(F.abs(A.norm(A.doubles("v")) - 1) > tolerance)
    return require(clouds, **checks)


def prototypes(clouds: DataFrame) -> DataFrame:
    """Unit rows, their mean, and the mean made a unit vector: (item, v)."""
    rows = clouds.select("item", F.posexplode(A.unit("v")).alias("k", "x"))
    mean = rows.groupBy("item", "k").agg(F.avg("x").alias("x"))
    whole = mean.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    return whole.withColumn("v", A.unit("v", "mean"))


KERNELS = {
    "energy": lambda d2, h, alpha: np.sqrt(d2, out=d2) if alpha == 1 else np.power(d2, alpha / 2, out=d2),
    "rbf": lambda d2, h, alpha: np.exp(np.divide(d2, -2 * h * h, out=d2), out=d2),
}


def _direct(x: np.ndarray, y: np.ndarray, d2: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> None:
    """Puts squared distances row by row at these places of d2: exact zeros for equal points; temporaries of at most DIFFERENCES elements."""
    step = max(1, DIFFERENCES // max(1, x.shape[1]))
    for i in range(0, len(at[0]), step):
        r, c = (k[i : i + step] for k in at)
        d2[r, c] = ((x[r] - y[c]) ** 2).sum(axis=1)


def _squared(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, close: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of two tiles by one product of (-2x, |x|^2, 1) and (y, 1, |y|^2); those that it would cancel, directly."""
    d2 = np.matmul(left, right, out=out)
    if d2.min() >= close.max():
        return d2
    rows = np.flatnonzero(~(d2.min(axis=1) >= close))  # not finite: directly as well
    r, c = np.nonzero(~(d2[rows] >= close[rows, None]))
    _direct(x, y, d2, (rows[r], c))
    return d2


def tile_sums(x: np.ndarray, code_i: np.ndarray, n_i: int, y: np.ndarray, code_j: np.ndarray, n_j: int, kernel: str, bandwidth: float = 1.0, alpha: float = 1.0) -> np.ndarray:
    """The kernel's sums over the points of x and of y by items, (n_j, n_i), in tiles of TILE points: no matrix of all pairs is held."""
    by_i, by_j = np.argsort(code_i, kind="stable"), np.argsort(code_j, kind="stable")
    x, code_i, y, code_j = x[by_i], code_i[by_i], y[by_j], code_j[by_j]
    if kernel == "linear":
        # a sum of products is the product of the sums
        return np.add.reduceat(y, _starts(code_j), axis=0) @ np.add.reduceat(x, _starts(code_i), axis=0).T
    left, right, nx = _factors(x, y)
    with np.errstate(over="ignore", invalid="ignore"):
        total, held, close = np.zeros((n_j, n_i)), np.empty(TILE[0] * TILE[1]), CLOSE * nx
        down = [(slice(r, r + TILE[0]), _starts(code_i[r : r + TILE[0]])) for r in range(0, len(x), TILE[0])]
        for c in range(0, len(y), TILE[1]):
            at = slice(c, c + TILE[1])
            part, across = np.ascontiguousarray(right[:, at]), _starts(code_j[at])
            sums = np.zeros((n_i, part.shape[1]))
            for own, starts in down:
                out = held[: len(left[own]) * part.shape[1]].reshape(-1, part.shape[1])
                k = KERNELS[kernel](_squared(x[own], y[at], left[own], part, close[own], out), bandwidth, alpha)
                for a, b in zip(starts, [*starts[1:], len(k)], strict=True):
                    sums[code_i[own][a]] += k[a:b].sum(axis=0)
            total[code_j[at][across]] += np.add.reduceat(sums, across, axis=1).T
    return total


def _factors(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(-2x, |x|^2, 1), (y, 1, |y|^2) in columns, whose product is squared distances, and |x|^2.

    Distances do not change with the origin; near the middle their products cancel least.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (x.mean(axis=0) + y.mean(axis=0)) / 2
        middle = np.where(np.isfinite(middle), middle, 0.0)
        px, py = x - middle, y - middle
        nx, ny = (px * px).sum(axis=1), (py * py).sum(axis=1)
        return np.column_stack([-2 * px, nx, np.ones(len(x))]), np.ascontiguousarray(np.column_stack([py, np.ones(len(y)), ny]).T), nx


def _starts(code: np.ndarray) -> np.ndarray:
    """Where each run of equal codes begins."""
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def _block_sums(kernel: str, bandwidth: float, alpha: float):
    """The sums of a pair of packed blocks, or of one block with itself, by items; none of a block whose other is empty."""

    def run(group: pa.Table) -> pa.Table:
        if _alone(group):
            kind = group.schema.field("items").type.value_type
            return pa.table([pa.array([], k) for k in (pa.bool_(), kind, kind, pa.float64())], names=["apart", "item_i", "item_j", "total"])
        sides = [(*pd.factorize(np.array(items.as_py(), object)), np.frombuffer(vecs.as_buffer(), np.float64)) for items, vecs in zip(group.column("items"), group.column("vecs"), strict=True)]
        (code_i, names_i, own_i), (code_j, names_j, own_j) = sides[0], sides[-1]
        total = tile_sums(own_i.reshape(len(code_i), -1), code_i, len(names_i), own_j.reshape(len(code_j), -1), code_j, len(names_j), kernel, bandwidth, alpha)
        i, j = np.meshgrid(np.arange(len(names_i)), np.arange(len(names_j)))
        kind = group.schema.field("items").type.value_type
        return pa.table([pa.array(np.full(i.size, len(sides) == 2)), pa.array(list(names_i[i.ravel()]), kind), pa.array(list(names_j[j.ravel()]), kind), pa.array(total.ravel())], names=["apart", "item_i", "item_j", "total"])

    return run


def _alone(group: pa.Table) -> bool:
    """Whether group is a block that was copied for another one, which holds no points."""
    return group.num_rows == 1 and "apart" in group.column_names and group.column("apart")[0].as_py()


def packed_blocks(clouds: DataFrame, blocks: int) -> DataFrame:
    """(own, items, vecs): the points of each block in one row, vectors as bytes."""
    item = clouds.schema["item"].dataType.simpleString()
    dealt = clouds.select("item", A.doubles("v").alias("v"), F.pmod(F.xxhash64("item", "key"), F.lit(blocks)).cast("int").alias("own"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        v = group.column("v").combine_chunks()
        kinds = [pa.int32(), pa.list_(group.schema.field("item").type), pa.binary()]
        columns = [[group.column("own")[0].as_py()], [group.column("item").to_pylist()], [np.asarray(v.flatten(), np.float64).tobytes()]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["own", "items", "vecs"])

    return dealt.repartitionById(blocks, "own").groupBy("own").applyInArrow(pack, f"own int, items array<{item}>, vecs binary")


def met_blocks(packed: DataFrame, blocks: int, tasks: int) -> DataFrame:
    """(pair, apart, items, vecs): every pair of blocks once, a block with itself included, dealt to the tasks by number, so that none has more than one pair above another."""
    copies = packed.select("own", "items", "vecs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    a, b = F.least("own", "other"), F.greatest("own", "other").cast("long")
    return copies.select((F.shiftright(b * (b + 1), 1) + a).cast("int").alias("pair"), (a != b).alias("apart"), "items", "vecs").repartitionById(tasks, "pair")


def block_points(n: int, width: int, items: int = 1) -> int:
    """Points of a block, where n of them are dealt to blocks."""
    row = 8 * max(width, 1)
    grown = min(max(n * row // MANY_BLOCKS, BLOCK_BYTES), GROWN * BLOCK_BYTES) if items <= FEW_ITEMS else BLOCK_BYTES
    return max(1, min(grown // row, BLOCK_POINTS if items <= FEW_ITEMS else BLOCK_POINTS // GROWN))


def blocks_of(n: int, width: int, items: int) -> int:
    """The number of blocks that n points are dealt to."""
    return min(max(-(-n // block_points(n, width, items)), LEAST_BLOCKS), max(n, 1))


def width_of(clouds: DataFrame) -> int:
    """The width of a first vector, as a cloud's have one width: looking at all would work out a derived v once more for every row."""
    first = clouds.where("v is not null").select(F.size("v").alias("d")).first()
    return max(first["d"], 1) if first else 1


def pair_means(clouds: DataFrame, kernel: str = "energy", bandwidth: float = 1.0, alpha: float = 1.0) -> DataFrame:
    """(item_i, item_j, mean) over all ordered point pairs, self pairs included: |x - y|^alpha, x.y, or exp(-|x - y|^2 / 2h^2).

    Blocks mix items, so many small clouds share a block and a large one spreads over several; only blocks a <= b meet. A block
    is copied to its pairs as one row, in a single shuffle, so a point travels as often as there are blocks, never as a row of its
    own. Tasks are counted in pairs, not in bytes, which adaptive plans would merge although the work is quadratic, and have equally
    many of them: a hash of the pair gives some task about twice the mean, and the others wait for it.
    """
    size, width = clouds.agg(F.count("*").alias("n"), F.approx_count_distinct("item").alias("items")).first(), width_of(clouds)
    blocks = blocks_of(size["n"], width, size["items"])
    pairs = blocks * (blocks + 1) // 2
    of_pair = 2 * 8 * width * -(-size["n"] // max(blocks, 1))
    tasks = min(pairs, max(TASKS_OF_CORE * clouds.sparkSession.sparkContext.defaultParallelism, -(-pairs * of_pair // TASK_BYTES)))
    met = met_blocks(packed_blocks(clouds, blocks), blocks, max(tasks, 1))
    item = clouds.schema["item"].dataType.simpleString()
    sums = met.groupBy("pair").applyInArrow(_block_sums(kernel, bandwidth, alpha), f"apart boolean, item_i {item}, item_j {item}, total double")
    # a pair of different blocks stands for both orders
    turned = F.struct(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j"))
    both = sums.select(F.explode(F.when(F.col("apart"), F.array(F.struct("item_i", "item_j"), turned)).otherwise(F.array(F.struct("item_i", "item_j")))).alias("p"), "total").select("p.*", "total")
    sizes = clouds.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # one row for each pair of items: written down, as callers read it several times and the work behind it is quadratic in the points
    total = kept(both.groupBy("item_i", "item_j").agg(F.sum("total").alias("total")), "pair-sums")
    met = total.join(sizes.select(F.col("item").alias("item_i"), F.col("n").alias("n_i")), "item_i").join(sizes.select(F.col("item").alias("item_j"), F.col("n").alias("n_j")), "item_j")
    return met.select("item_i", "item_j", (F.col("total") / (F.col("n_i") * F.col("n_j"))).alias("mean"), "n_i", "n_j")


def own_means(clouds: DataFrame, kernel: str = "energy", bandwidth: float = 1.0, alpha: float = 1.0) -> DataFrame:
    """(item, mean, n): pair_means of each item with itself alone; points of different items never meet.

    An item of more points than a block holds is dealt to blocks of its own, whose pairs a <= b meet; several smaller ones share a
    block, which meets itself, item by item. The pairs are those within items, which for k items of one size are a kth of all.
    """
    clouds = clouds.where("item is not null")
    width = width_of(clouds)
    sizes = clouds.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    block = block_points(sizes.agg(F.max("n")).first()[0] or 0, width)
    parts = F.ceil(F.col("n") / block)
    pairs = F.shiftright(parts * (parts + 1), 1)
    small = F.when(parts == 1, F.col("n"))
    load = sizes.agg(F.coalesce(F.sum(small), F.lit(0)).alias("small"), F.coalesce(F.sum(F.when(parts > 1, pairs)), F.lit(0)).alias("pairs")).first()
    # half full on average, as a hash fills them unevenly
    shared = max(1, -(-2 * load["small"] // block))
    # items of several blocks are at most as many as there are blocks
    large = sizes.where(parts > 1).select("item", parts.cast("int").alias("parts"))
    item = clouds.schema["item"].dataType.simpleString()
    own = clouds.select("item", "key", A.doubles("v").alias("v")).join(F.broadcast(large), "item", "left")
    # whole: the item whose points alone are in the block, null where items share it
    whole = F.when(F.col("parts").isNotNull(), F.col("item")).alias("whole")
    place = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("item"), F.lit(shared))).otherwise(F.pmod(F.xxhash64("item", "key"), F.col("parts"))).cast("int").alias("own")
    packed = own.select("item", "v", whole, place, F.coalesce("parts", F.lit(1)).alias("parts"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        vecs = np.asarray(group.column("v").combine_chunks().flatten(), np.float64).tobytes()
        kind = group.schema.field("item").type
        columns = [group.column("whole")[0].as_py()], [group.column("own")[0].as_py()], [group.column("parts")[0].as_py()], [group.column("item").to_pylist()], [vecs]
        return pa.table([pa.array(c, k) for c, k in zip(columns, [kind, pa.int32(), pa.int32(), pa.list_(kind), pa.binary()], strict=True)], names=["whole", "own", "parts", "items", "vecs"])

    packed = packed.groupBy("whole", "own", "parts").applyInArrow(pack, f"whole {item}, own int, parts int, items array<{item}>, vecs binary")
    other = F.when(F.col("whole").isNull(), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    copies = packed.select("whole", "own", "items", "vecs", F.explode(other).alias("other"))
    met = copies.select("whole", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") != F.col("other")).alias("apart"), "items", "vecs")
    groups = load["pairs"] + shared
    tasks = min(groups, max(TASKS_OF_CORE * clouds.sparkSession.sparkContext.defaultParallelism, -(-groups * 2 * 8 * width * block // TASK_BYTES)))

    def sums(group: pa.Table) -> pa.Table:
        if _alone(group):
            return pa.table([pa.array([], group.schema.field("items").type.value_type), pa.array([], pa.float64())], names=["item", "total"])
        sides = [(items.values, np.frombuffer(vecs.as_buffer(), np.float64).reshape(len(items), -1)) for items, vecs in zip(group.column("items"), group.column("vecs"), strict=True)]
        (items, x), y = sides[0], sides[-1][1]
        if len(sides) == 2:
            one = lambda v: np.zeros(len(v), int)
            return pa.table([items[:1], pa.array([2 * tile_sums(x, one(x), 1, y, one(y), 1, kernel, bandwidth, alpha)[0, 0]])], names=["item", "total"])
        code, names = pd.factorize(np.array(items.to_pylist(), object))
        runs = np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code))[:-1])
        each = [tile_sums(x[r], code[r] * 0, 1, x[r], code[r] * 0, 1, kernel, bandwidth, alpha)[0, 0] for r in runs]
        return pa.table([pa.array(list(names), items.type), pa.array(each)], names=["item", "total"])

    total = met.repartition(max(tasks, 1), "whole", "a", "b").groupBy("whole", "a", "b").applyInArrow(sums, f"item {item}, total double")
    return total.groupBy("item").agg(F.sum("total").alias("total")).join(sizes, "item").select("item", (F.col("total") / (F.col("n") * F.col("n"))).alias("mean"), "n")


def query_distances(queries: DataFrame, clouds: DataFrame, decimals: int | None = None) -> DataFrame:
    """(i, j, euclidean, cosine, angular) from each row of queries to every row of clouds with another key, to so many decimals.

    Both sides are dealt to blocks, each packed into one row; a block of queries meets every block of rows, one pair a group, and the
    distances leave it in batches of about BATCH_ROWS, so neither a task's memory nor what is broadcast grows with the tables. Those of up
    to PAIRS_HELD pairs leave in ascending order: equal rounded values then stand together, and a written table takes a quarter of the
    bytes. Rounding in the batches spares a decimal number for each value.
    """
    kind = clouds.schema["key"].dataType.simpleString()

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _between(batches, decimals=decimals)

    return met_queries(queries, clouds).groupBy("pair").applyInArrow(between, f"i {kind}, j {kind}, euclidean double, cosine double, angular double")


def met_queries(queries: DataFrame, clouds: DataFrame) -> DataFrame:
    """(pair, query, items, vecs): a block of queries and a block of rows for each pair of such blocks, dealt to the tasks by the pair's number."""
    sides = []
    for side in (queries, clouds):
        side = side.where("key is not null")
        size = side.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        blocks = max(1, -(-size["n"] * 8 * max(size["d"] or 1, 1) // BLOCK_BYTES))
        sides.append((packed_blocks(side.select(F.col("key").alias("item"), "key", "v"), blocks).select("own", "items", "vecs"), blocks))
    (a, n_a), (b, n_b) = sides
    copies = lambda df, others, query: df.select("own", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"), F.lit(query).alias("query"), "items", "vecs")
    met = copies(a, n_b, True).unionByName(copies(b, n_a, False))
    pair = F.when(F.col("query"), F.col("own") * n_b + F.col("other")).otherwise(F.col("other") * n_b + F.col("own")).cast("int")
    tasks = min(n_a * n_b, max(TASKS_OF_CORE * clouds.sparkSession.sparkContext.defaultParallelism, -(-n_a * n_b * 2 * BLOCK_BYTES // TASK_BYTES)))
    return met.select(pair.alias("pair"), "query", "items", "vecs").repartitionById(tasks, "pair")


class VectorDistances:
    """The table function of register: the decimals of a distance, and rows of met_queries in order of their pairs."""

    def __init__(self) -> None:
        self.pair: list[pa.RecordBatch] = []
        self.decimals = 0

    def eval(self, decimals: pa.Array, blocks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.decimals = decimals[0].as_py()
        number = blocks.schema.get_field_index("pair")
        for k in range(blocks.num_rows):
            own = blocks.slice(k, 1)
            if self.pair and self.pair[0].column(number) != own.column(number):
                yield from self.terminate()
            self.pair.append(own)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        pair, self.pair = self.pair, []
        if pair:
            yield from _between(pair, ("euclidean",), True, self.decimals)


def register(spark: SparkSession, kind: str = "bigint") -> None:
    """vector_distances(decimals, TABLE(blocks)) as a table function of the session, over the rows of met_queries, each task's in order of pair.

    It gives (i, j, euclidean) of every query and every row, a query's own row included. A function of two vectors, called for each pair
    of a join, evaluates two lambdas for each coordinate of each pair. PARTITION BY would deal the pairs of blocks by a hash and by bytes.
    """
    spark.udtf.register("vector_distances", F.arrow_udtf(VectorDistances, returnType=f"i {kind}, j {kind}, euclidean double"))


def _between(batches: Iterable[pa.RecordBatch], metrics: tuple[str, ...] = ("euclidean", "cosine", "angular"), same: bool = False, decimals: int | None = None) -> Iterator[pa.RecordBatch]:
    """The distances of a block of queries and a block of rows, in batches, ascending within PAIRS_HELD of them. same: of equal keys as well."""
    group = pa.Table.from_batches(list(batches))
    if group.num_rows < 2:
        return
    q, r = (0, 1) if group.column("query")[0].as_py() else (1, 0)
    names = [group.column("items")[k].values for k in (q, r)]
    x, y = (np.frombuffer(group.column("vecs")[k].as_buffer(), np.float64).reshape(len(n), -1) for k, n in zip((q, r), names, strict=True))
    places: dict = {}
    for at, key in enumerate(() if same else names[1].to_pylist()):
        places.setdefault(key, []).append(at)
    own = [places.get(key, []) for key in names[0].to_pylist()]
    left, right, nx = _factors(x, y)
    length_x, length_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    held = -(-len(x) // -(-len(x) * len(y) // PAIRS_HELD))
    step = max(1, DIFFERENCES // len(y))
    shown = lambda v: v if decimals is None else np.round(v, decimals) + 0.0
    for k in range(0, len(x), held):
        d, others = np.empty((min(held, len(x) - k), len(y))), np.ones((min(held, len(x) - k), len(y)), bool)
        cos = np.empty_like(d) if len(metrics) > 1 else d
        for t in range(0, len(d), step):
            rows = slice(t, min(t + step, len(d)))
            at = slice(k + rows.start, k + rows.stop)
            np.sqrt(_squared(x[at], y, left[at], right, CLOSE * nx[at], d[rows]), out=d[rows])
            if cos is not d:
                with np.errstate(divide="ignore", invalid="ignore"):
                    np.clip(x[at] @ y.T / (length_x[at, None] * length_y), -1.0, 1.0, out=cos[rows])
        for row, equal in enumerate(own[k : k + len(d)]):
            others[row, equal] = False
        order = _ascending(d.ravel())
        for c in range(0, len(order), BATCH_ROWS):
            o = order[c : c + BATCH_ROWS]
            o = o[others.ravel()[o]]
            i, j = np.divmod(o, len(y))
            cosine = cos.ravel()[o]
            value = {"euclidean": lambda o=o: d.ravel()[o], "cosine": lambda v=cosine: 1 - v, "angular": lambda v=cosine: np.arccos(v)}
            yield pa.RecordBatch.from_arrays([names[0].take(pa.array(i + k)), names[1].take(pa.array(j)), *(pa.array(shown(value[m]())) for m in metrics)], names=["i", "j", *metrics])


def _ascending(d: np.ndarray) -> np.ndarray:
    """Places of d by its values, none of them negative, which count to about nine digits; NaN last.

    Bits of such numbers are in the order of the numbers. Their last ones give way to the place, so one sort of plain numbers does: a
    third of the time of argsort.
    """
    low = np.uint64((1 << max(1, (d.size - 1).bit_length())) - 1)
    keys = d.view(np.uint64) & ~low
    keys |= np.arange(d.size, dtype=np.uint32)
    keys.sort()
    keys &= low
    return keys.view(np.int64)


def pair_means_sql(clouds: DataFrame, point: Column | None = None, limit: int = 4000) -> DataFrame:
    """The same means by DataFrame expressions over all point pairs, for at most limit rows. point: an expression of x and y."""
    if clouds.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} points: use pair_means")
    a = clouds.select(F.col("item").alias("item_i"), A.doubles("v").alias("x"))
    b = clouds.select(F.col("item").alias("item_j"), A.doubles("v").alias("y"))
    value = A.euclidean("x", "y") if point is None else point
    return a.join(F.broadcast(b), F.lit(True)).groupBy("item_i", "item_j").agg(F.avg(value).alias("mean"))


def from_component(component: DataFrame, sign: float = 1.0) -> DataFrame:
    """(item_i, item_j, value) = sign (2 M_ij - M_ii - M_jj), exactly 0 on the diagonal."""
    own = component.where("item_i = item_j")
    met = component.join(own.select("item_i", F.col("mean").alias("ii")), "item_i").join(own.select("item_j", F.col("mean").alias("jj")), "item_j")
    value = sign * (2 * F.col("mean") - F.col("ii") - F.col("jj"))
    return met.select("item_i", "item_j", F.when(F.col("item_i") == F.col("item_j"), 0.0).otherwise(value).alias("value"))


def energy(clouds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Energy functional 2A_ij - A_ii - A_jj of V-statistics, neither halved nor rooted."""
    return from_component(pair_means(clouds, "energy", alpha=alpha))


def energy_metric(functional: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Square root of the functional; one materially below zero, or not finite, is an error."""
    require(functional, fit=none(F.col("value").isNull() | F.isnan("value") | (F.col("value") < -tolerance)))
    return functional.withColumn("value", A.root("value"))


def mmd(clouds: DataFrame, kernel: str = "linear", bandwidth: float = 1.0, normalization: str = "unhalved") -> DataFrame:
    """Squared MMD K_ii + K_jj - 2 K_ij: unhalved, halved, or rooted."""
    squared = from_component(pair_means(clouds, kernel, bandwidth), -1.0)
    scale = {"unhalved": F.col("value"), "halved": F.col("value") / 2, "rooted": A.root("value")}[normalization]
    return squared.withColumn("value", scale)


def median_bandwidth(clouds: DataFrame, cap: int = 512) -> float:
    """Median positive distance among at most cap rows, evenly spaced in the order of item and key."""
    # a row's place is its item's offset (a row for each item) and its rank among that item's keys, so no task sees all rows
    sizes = sorted((r["item"], r["n"]) for r in clouds.groupBy("item").agg(F.count(F.lit(1)).alias("n")).collect())
    n, starts = 0, []
    for item, k in sizes:
        starts.append((item, n))
        n += k
    picks = sorted({int(x) for x in np.linspace(0, n - 1, min(n, cap))}) if n else []
    kind = clouds.schema["item"].dataType.simpleString()
    spark = clouds.sparkSession
    offset = F.broadcast(spark.createDataFrame(starts, f"item {kind}, _start long"))
    place = clouds.select("item", "key").withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy("key")) - 1).join(offset, "item").select("item", "key", (F.col("_start") + F.col("_r")).alias("p"))
    wanted = place.join(F.broadcast(spark.createDataFrame([(p,) for p in picks], "p long")), "p")
    chosen = clouds.join(F.broadcast(wanted), ["item", "key"])
    a, b = chosen.select("p", A.doubles("v").alias("x")), chosen.select(F.col("p").alias("q"), A.doubles("v").alias("y"))
    d = a.join(F.broadcast(b), F.col("p") < F.col("q")).select(A.euclidean("x", "y").alias("d")).where("d > 0")
    return d.agg(F.median("d")).first()[0]


def within_terms(clouds: DataFrame) -> DataFrame:
    """(item, v, u): mean distance within a cloud over n^2 and over n (n - 1) pairs (the dispersion is v)."""
    m = own_means(clouds)
    n = F.col("n")
    return m.select("item", F.col("mean").alias("v"), F.when(n > 1, F.col("mean") * n / (n - 1)).alias("u"))


def wasserstein(clouds: DataFrame, order: int = 2, m: int | None = None) -> DataFrame:
    """Exact balanced Wasserstein distance of all pairs of items: (item_i, item_j, value), i < j.

    Every pair is a task of its own; the clouds must have equal sizes (the first m rows if m is given).
    """
    rows = first_rows(clouds, m) if m else clouds
    whole = rows.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "v"))), lambda s: A.doubles(s["v"])).alias("points"))
    require(whole, equal_sizes=F.min(F.size("points")) == F.max(F.size("points")))
    a = whole.select(F.col("item").alias("item_i"), F.col("points").alias("x"))
    b = whole.select(F.col("item").alias("item_j"), F.col("points").alias("y"))
    pairs = a.join(b, F.col("item_i") < F.col("item_j"))

    def solve(batches):
        for pdf in batches:
            values = [balanced_assignment(np.stack([*map(np.asarray, x)]), np.stack([*map(np.asarray, y)]), order)[0] for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pd.DataFrame({"item_i": pdf["item_i"], "item_j": pdf["item_j"], "value": values})

    item = clouds.schema["item"].dataType.simpleString()
    return pairs.repartition("item_i", "item_j").mapInPandas(solve, f"item_i {item}, item_j {item}, value double")


def axis_w2(left: str, right: str) -> Column:
    """Closed form for mixtures on signed axes: sum |p - q|."""
    return F.aggregate(F.zip_with(left, right, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v)


def widths(clouds: DataFrame, full: DataFrame, sizes: list[int], distance=energy) -> DataFrame:
    """Pearson correlation of the distances at each prefix width with the full ones: (width, pearson)."""
    out = None
    for d in sizes:
        at = distance(representation(clouds, d)).where("item_i < item_j").withColumnRenamed("value", "short").join(full, ["item_i", "item_j"])
        row = at.agg(F.lit(d).alias("width"), F.corr("short", "value").alias("pearson"))
        out = row if out is None else out.unionByName(row)
    return out


#: family -> function of clouds and options; new distances register here.
FAMILIES = {"energy": energy, "mmd": mmd, "wasserstein": wasserstein}


def distance(clouds: DataFrame, family: str, **options) -> DataFrame:
    """Dispatch by registered family."""
    if family not in FAMILIES:
        raise KeyError(f"no distance family {family}; known: {sorted(FAMILIES)}")
    return FAMILIES[family](clouds, **options)
