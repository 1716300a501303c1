"""Exact set similarity join on word shingles by set-relation skipping.

A document is the set of its distinct 4-word shingles; two link when their Jaccard similarity is at least 0.85. Equal sets are
one set. The join goes from cheap to dear, and every step is exact:

1. Index lists. A set is listed under the tokens of its prefix, which any partner must share one of, with its position there.
   Tokens with lists of more than HOT sets (by a Bloom filter of a bounded size, broadcast) go to the end of the token order, so a
   passage that many documents hold lists none of them unless a set has little else. A list is cut into blocks by size class and position: a set meets the sets of its own class,
   and those of the next larger class only from positions that leave enough tokens for an overlap with the smallest of them;
   the block of its later positions is skipped there.
2. Relations. All sets of a list block relate to one leader, the member with the smallest hash. A pair that shares a
   listed token shares its leader, so the groups of leaders hold every pair, and lists that repeat a relation are skipped.
3. Positions again. Within a group, prefixes alone bound the overlap: tokens of one prefix below the other's last position that
   the other lacks are lost for good. Pairs that lose too much are dropped before any set is fetched.
4. Answers. Within a block of a group, a set's overlaps with all others are derived from those of the most similar set that has
   been answered already: only the index lists of the tokens in which the two differ are read (`answers`). What a
   component has already answered is not asked again: in groups of more than one block, only sets outside the largest component are
   compared across blocks, with sets of other components, and only if their distances from the leader (a metric) differ by
   no more than a link allows; blocks are made within cells of that distance, so a set is copied to the blocks that may need it.

No step emits pairs or gathers a list: lists are counted and reduced by partial aggregation, groups are dealt in blocks of at
most BLOCK_SETS sets and BLOCK_BYTES bytes, and blocks return spanning forests. Connected components run as tables.

Defined cases: a text without words (or null) is an empty set and links with nothing; with fewer words than a shingle the whole
sequence is one shingle; rows with equal ids are documents of their own; a null id counts as larger than any other; further
columns are ignored. A text is read whole, in memory of about forty times its bytes; batches hold about 2 MB of other texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import SALTS, bloom_of, joined_back, last_only, materialize, merge, table, text_slices, tidy
from lodestrata.llm.graph import components
from lodestrata.llm.words import SPACED, find_words, mix, ranges, shingles, word_hashes

SHINGLE, PERCENT = 4, 85
HOT = 32
BLOCK_SETS, BLOCK_BYTES = 512, 8 << 20
_SALT = np.uint64(0x5851F42D4C957F2D)


def token_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, raw, offsets in text_slices(column):
        b, starts, lengths, bounds = find_words(raw, offsets, SPACED, nul_is_word=True)
        h, cut = shingles(word_hashes(b, starts, lengths), bounds, k)
        for i in range(hi - lo):
            yield np.unique(h[cut[i] : cut[i + 1]])


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return tuple(int(x) for x in np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _SALT).sum(dtype=np.uint64)], np.uint64).view(np.int64))


def needed(n: int, percent: int) -> int:
    """The smallest overlap of a set of n with any partner."""
    return (percent * n + 99) // 100


def prefix_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1 if n else 0


def size_class(n: int, percent: int) -> int:
    """Sizes that can link differ by at most one class."""
    return int(math.log(n) / -math.log(percent / 100 - 1e-4)) if n else -1


def links(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)


SETS = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def describe(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """row, key, doc_id, set size, size class, fingerprint and prefix of each document (doc_id, text, key)."""

    def run(batches):
        number = 0
        for batch in batches:
            cols: list[list] = [[] for _ in SETS]
            for key, doc_id, s in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), token_sets(batch.column("text"), shingle), strict=True):
                row = (number, key, doc_id, len(s), size_class(len(s), percent), *fingerprint(s), s[: prefix_length(len(s), percent)].view(np.int64))
                number += 1
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SETS, strict=True)], schema=SETS)

    out = docs.select("doc_id", "text", "key").mapInArrow(tidy(run), "row long, key long, doc_id long, n long, cls int, f1 long, f2 long, prefix array<long>")
    return out.withColumn("row", F.spark_partition_id() * F.lit(1 << 33) + F.col("row"))


TOKENS = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])


def sets_of(shingle: int, held) -> Callable:
    """doc_id, fingerprint, n and tokens (sorted, as bytes) of the texts whose ids may be among the wanted ones."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(held.value.may_hold(batch.column("doc_id"))))
            out = [(doc_id, *fingerprint(s), len(s), s.tobytes()) for doc_id, s in zip(batch.column("doc_id").to_pylist(), token_sets(batch.column("text"), shingle), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(TOKENS)], schema=TOKENS)

    return run


def claimed(found: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """rep and columns of the rows found that are wanted (rep, doc_id, f1, f2): the filter in front may let others pass."""
    w = wanted.select(F.col("doc_id").alias("id"), "rep", F.col("f1").alias("w1"), F.col("f2").alias("w2"))
    return found.join(merge(w), (F.col("f1") == F.col("w1")) & (F.col("f2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("rep", *columns)


def fetch(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """rep, n and tokens of the wanted sets (rep, doc_id, f1, f2), from one more pass over the texts.

    A Bloom filter of bounded size keeps most other texts from being cut up and sent; past its capacity it only filters less.
    """
    found = docs.select("doc_id", "text").mapInArrow(tidy(sets_of(shingle, bloom_of(wanted, "doc_id"))), "doc_id long, f1 long, f2 long, n long, tokens binary")
    return claimed(found, wanted, "n", "tokens")


WANTED = pa.schema([("rep", pa.int64()), ("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])


def warm_sets(distinct: DataFrame, hot) -> DataFrame:
    """rep, doc_id, f1, f2 of the sets with a hot token in their prefix. hot: a broadcast filter of tokens.

    The filter may take other tokens for hot ones. That only moves them to the end of the order as well, and since it says the
    same of a token in every set, the order stays one order.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column("prefix")
            hit = np.concatenate([[0], np.cumsum(hot.value.may_hold(np.asarray(lists.values, np.int64)))])
            offsets = np.asarray(lists.offsets)
            warm = hit[offsets[1:]] > hit[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(warm)) for c in WANTED.names], schema=WANTED)

    return distinct.select(*WANTED.names, "prefix").mapInArrow(run, "rep long, doc_id long, f1 long, f2 long")


COOLER = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("cls", pa.int32()), ("prefix", pa.list_(pa.int64()))])


def cooler_prefixes(docs: DataFrame, wanted: DataFrame, hot, shingle: int, percent: int) -> DataFrame:
    """Prefixes (rep, n, cls, prefix) of the wanted sets in the token order that has hot tokens last."""
    held = bloom_of(wanted, "doc_id")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(held.value.may_hold(batch.column("doc_id"))))
            cols: list[list] = [[] for _ in COOLER]
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), token_sets(batch.column("text"), shingle), strict=True):
                t, m = s.view(np.int64), hot.value.may_hold(s.view(np.int64))
                row = (doc_id, *fingerprint(s), len(s), size_class(len(s), percent), np.concatenate([t[~m], t[m]])[: prefix_length(len(s), percent)])
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, COOLER, strict=True)], schema=COOLER)

    found = docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, f1 long, f2 long, n long, cls int, prefix array<long>")
    return claimed(found, wanted, "n", "cls", "prefix")


def postings(sets: DataFrame) -> DataFrame:
    """(t, rep, n, cls, pos): a row for each token of the prefixes of sets, with its position."""
    return sets.select("rep", "n", "cls", F.posexplode("prefix").alias("pos", "t"))


def last_position(percent: int) -> Column:
    """The last position from which a set of n tokens can overlap enough with the smallest set of the next size class."""
    smallest = F.floor(F.exp((F.col("cls") + 1) * -math.log(percent / 100 - 1e-4)) - 1e-6)
    return F.col("n") - F.ceil(percent * (F.col("n") + smallest) / (100 + percent) - 1e-9)


def relations(lists: DataFrame, percent: int) -> DataFrame:
    """(leader, band, rep): the groups. lists: the postings of all sets."""
    shared = lists.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    bands = F.when(F.col("pos") <= last_position(percent), F.array(F.col("cls"), F.col("cls") + 1)).otherwise(F.array("cls"))
    banded = materialize(lists.join(merge(shared), "t").select("t", "rep", "cls", F.explode(bands).alias("band")), "lists")
    leaders = banded.groupBy("t", "band").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep"))).alias("m"), F.count("*").alias("c"), F.max(F.col("cls") == F.col("band")).alias("own")).where("c > 1 and own").select("t", "band", F.col("m.rep").alias("leader"))
    return banded.join(merge(leaders), ["t", "band"]).select("leader", "band", "rep").distinct()


def grouped(batches, key: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys in batches that are sorted by key."""
    now, held = None, {}
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keys = list(zip(*(cols[k] for k in key), strict=True))
        for i, k in enumerate(keys):
            if k != now:
                if now is not None:
                    yield now, held
                now, held = k, {n: [] for n in cols}
            for n, c in cols.items():
                held[n].append(c[i])
    if now is not None:
        yield now, held


def by_block(df: DataFrame, key: list[str], run: Callable, ddl: str) -> DataFrame:
    """Bring each block together, sorted, and run over blocks one after the other."""
    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidy(run), ddl)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of short sets, by products of 0/1 matrices over shared tokens."""
    lens = np.array([len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lens)
    shared = count[token] > 1
    number = np.cumsum(count > 1) - 1
    token, owner = number[token[shared]], owner[shared]
    m, width = len(sets), int((count > 1).sum())
    out = np.zeros((m, m), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    step = max(256, (4 << 20) // max(m, 1))
    for lo in range(0, width, step):
        i, j = np.searchsorted(token, [lo, lo + step])
        x = np.zeros((m, min(step, width - lo)), np.float32)
        x[owner[i:j], token[i:j] - lo] = 1
        out += x @ x.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, lens)
    return out


def answers(sets: list[np.ndarray], rows: int | None = None) -> np.ndarray:
    """Sizes of the intersections of the first `rows` sets (of all, if None) with every set, one set's answers from another's.

    The next set is the one that differs least from a set that has been answered. Its overlaps are that set's, plus the index lists
    of the tokens that it has beside, less those of the tokens that it lacks; a set that is like none starts from nothing.
    """
    m, rows = len(sets), len(sets) if rows is None else rows
    size = np.array([len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(token, kind="stable")
    lists, head = owner[order], np.concatenate([[0], np.cumsum(count)])
    tokens = np.split(token, np.cumsum(size)[:-1])
    mark = np.zeros(len(count), bool)
    out = np.zeros((rows, m), np.int64)
    differ, like = size[:rows].copy(), np.full(rows, -1)
    open_ = np.ones(rows, bool)
    for _ in range(rows):
        i = int(np.where(open_, differ, np.iinfo(np.int64).max).argmin())
        mine, r = tokens[i], like[i]
        if r >= 0:
            mark[tokens[r]] = True
            more = mine[~mark[mine]]
            mark[tokens[r]] = False
            mark[mine] = True
            less = tokens[r][~mark[tokens[r]]]
            mark[mine] = False
            at = np.concatenate([more, less])
            n = count[at]
            sign = np.repeat(np.where(np.arange(len(at)) < len(more), 1.0, -1.0), n)
            out[i] = out[r] + np.rint(np.bincount(lists[ranges(head[at], n)], sign, m)).astype(np.int64)
        else:
            out[i] = np.bincount(lists[ranges(head[mine], count[mine])], minlength=m)
        open_[i] = False
        apart = size[i] + size[:rows] - 2 * out[i, :rows]
        closer = open_ & (apart < differ)
        differ[closer], like[closer] = apart[closer], i
    return out


def possible(prefixes: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that their prefixes do not rule out. Prefixes are in the same token order and unsigned ascending."""
    inter = overlaps(prefixes)
    last = np.array([p[-1] for p in prefixes])
    # tokens of i's prefix up to the end of j's prefix, which j must hold in its prefix to share
    below = np.array([np.searchsorted(p, last, "right") for p in prefixes])
    most = np.minimum(n[:, None] - (below - inter), n[None, :] - (below.T - inter))
    np.minimum(most, np.minimum(n[:, None], n[None, :]), out=most)
    return links(most, n, n, percent)


def forest(adjacent: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, for a symmetric matrix with a true diagonal."""
    label = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, label[None, :], len(adjacent)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unique_members(rows: dict[str, list]) -> np.ndarray:
    return np.unique(np.array(rows["rep"], np.int64), return_index=True)[1]


def survivors(groups: DataFrame, percent: int) -> DataFrame:
    """(leader, band, sub, rep): the members of each small group that some other member may link with, by connected part."""
    schema = pa.schema([("leader", pa.int64()), ("band", pa.int32()), ("sub", pa.int64()), ("rep", pa.int64())])

    def run(batches):
        held: list[tuple] = []
        for (leader, band), rows in grouped(batches, ["leader", "band"]):
            at = unique_members(rows)
            p = [np.array(rows["prefix"][i], np.int64).view(np.uint64) for i in at]
            n = np.array([rows["n"][i] for i in at])
            label = forest(possible(p, n, percent))
            size = np.bincount(label, minlength=len(label))
            held += [(leader, band, rows["rep"][at[label[k]]], rows["rep"][i]) for k, i in enumerate(at) if size[label[k]] > 1]
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
                held = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    return by_block(groups, ["leader", "band"], run, "leader long, band int, sub long, rep long")


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def compare_within(blocks: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the links within each block (leader, band, sub) of (rep, tokens)."""

    def run(batches):
        held: list[tuple] = []
        for _, rows in grouped(batches, ["leader", "band", "sub"]):
            at = unique_members(rows)
            if len(at) < 2:
                continue
            s = [np.frombuffer(rows["tokens"][i], np.uint64) for i in at]
            n = np.array([len(x) for x in s])
            label = forest(links(answers(s), n, n, percent))
            held += [(rows["rep"][at[k]], rows["rep"][at[label[k]]]) for k in range(len(at)) if label[k] != k]
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.int64()) for i in range(2)], schema=EDGES)
                held = []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.int64()) for i in range(2)], schema=EDGES)

    return by_block(blocks, ["leader", "band", "sub"], run, "a long, b long")


ACROSS = ["leader", "band", "cell", "over", "i", "j"]


def compare_across(blocks: DataFrame, percent: int) -> DataFrame:
    """Links between rows (side 0) and columns (side 1) of blocks of ACROSS, other than within a component.

    Rows are outside the largest component; a pair of which both sides are (`open`) meets twice and is looked at once.
    """

    def run(batches):
        for _, rows in grouped(batches, ACROSS):
            side = np.array(rows["side"])
            pick = [[i for i in np.flatnonzero(side == k)] for k in (0, 1)]
            if not pick[0] or not pick[1]:
                continue
            s = [[np.frombuffer(rows["tokens"][i], np.uint64) for i in p] for p in pick]
            root = [np.array([rows["root"][i] for i in p]) for p in pick]
            far = [np.array([rows["far"][i] for i in p]) for p in pick]
            once = ~np.array([rows["open"][i] for i in pick[1]], bool)
            open_pairs = (root[0][:, None] < root[1][None, :]) | ((root[0][:, None] > root[1][None, :]) & once[None, :])
            open_pairs &= np.abs(far[0][:, None] - far[1][None, :]) <= 1 - percent / 100 + 1e-9
            r, c = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
            if not len(r):
                continue
            n = [np.array([len(x) for x in p]) for p in s]
            inter = answers([s[0][i] for i in r] + [s[1][i] for i in c], len(r))[:, len(r) :]
            ok = links(inter, n[0][r], n[1][c], percent) & open_pairs[np.ix_(r, c)]
            a, b = (np.array([rows["rep"][i] for i in p]) for p in pick)
            # one link for each pair of components joins them
            x, y = np.nonzero(ok)
            _, one = np.unique(np.stack([root[0][r[x]], root[1][c[y]]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(a[r[x[one]]]), pa.array(b[c[y[one]]])], schema=EDGES)

    return by_block(blocks, ACROSS, run, "a long, b long")


def distances(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Add far, the Jaccard distance of each member (leader, band, rep) from its leader's set."""
    schema = pa.schema([("leader", pa.int64()), ("band", pa.int32()), ("rep", pa.int64()), ("far", pa.float64())])

    def run(batches):
        for batch in batches:
            far = []
            for x, y in zip(batch.column("tokens").to_pylist(), batch.column("of").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                k = len(np.intersect1d(a, b, assume_unique=True))
                far.append(1 - k / max(len(a) + len(b) - k, 1))
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("band"), batch.column("rep"), pa.array(far, pa.float64())], schema=schema)

    of = sets.join(merge(members.select(F.col("leader").alias("rep")).distinct()), "rep").select(F.col("rep").alias("leader"), F.col("tokens").alias("of"), salts())
    full = salted(members.select("leader", "band", "rep")).join(merge(sets.select("rep", "tokens")), "rep")
    return full.join(merge(of), ["leader", "salt"]).select("leader", "band", "rep", "tokens", "of").mapInArrow(run, "leader long, band int, rep long, far double")


def salts() -> Column:
    """Copies of a row that describes a group, so that the group's members join it from several tasks."""
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def salted(members: DataFrame) -> DataFrame:
    return members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))


def routes(members: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """members with the cell of their distance, and the pairs of cells (leader, band, cell, over, rows, columns) that have to meet.

    Distances of members that link differ by no more than reach, the width of a cell, so they are in one cell or in neighbouring
    ones. rows: blocks of the open members of the cell; columns: blocks of all members of the cell `over`.
    """
    placed = materialize(members.withColumn("cell", F.floor(F.col("far") / reach)), "cells")
    crowd = placed.groupBy("leader", "band", "cell").agg(F.ceil(F.sum(F.col("open").cast("int")) / F.max("fits")).alias("rows"), F.ceil(F.count("*") / F.max("fits")).alias("columns"))
    crowd = materialize(crowd, "crowds")
    beside = crowd.where("rows > 0").select("leader", "band", "cell", "rows", F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("over"))
    return placed, beside.join(merge(crowd.select("leader", "band", F.col("cell").alias("over"), "columns")), ["leader", "band", "over"])


def big_group_links(big: DataFrame, sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Links across the blocks of groups (leader, band, rep, fits) that still hold several components.

    Rows are the members outside the largest component. They and the members they may link with are copied once for each block
    of the other side, and only there; tokens come to a member when it is known to have such a block.
    """
    roots = components(edges)
    known = big.join(merge(roots.withColumnRenamed("node", "rep")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    parts = known.groupBy("leader", "band", "root").agg(F.count("*").alias("c"))
    largest = parts.groupBy("leader", "band").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("leader", "band", F.col("m.root").alias("giant"), salts())
    left = salted(known).join(merge(largest), ["leader", "band", "salt"]).select("leader", "band", "rep", "fits", "root", (F.col("root") != F.col("giant")).alias("open"))
    left = materialize(left, "open")
    if left.isEmpty():
        return big.sparkSession.createDataFrame([], "a long, b long")
    placed, meet = routes(left.join(merge(distances(left, sets)), ["leader", "band", "rep"]), 1 - percent / 100 + 1e-6)
    meet = materialize(meet.select("*", salts()), "routes")
    rows = salted(placed.where("open")).join(merge(meet), ["leader", "band", "cell", "salt"]).withColumn("side", F.lit(0))
    columns = salted(placed).withColumnRenamed("cell", "over").join(merge(meet), ["leader", "band", "over", "salt"]).withColumn("side", F.lit(1))
    names = ["leader", "band", "cell", "over", "rows", "columns", "side", "rep", "root", "far", "open"]
    full = rows.select(names).unionByName(columns.select(names)).join(merge(sets.select("rep", "tokens")), "rep")
    # the side's own block, and every block of the other side
    own = lambda n: F.pmod(F.xxhash64("rep", F.lit(1)), F.col(n))
    i = F.when(F.col("side") == 0, F.array(own("rows"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
    j = F.when(F.col("side") == 1, F.array(own("columns"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))
    dealt = full.select("*", F.explode(i).alias("i")).select("*", F.explode(j).alias("j"))
    return compare_across(dealt.select(*ACROSS, "side", "rep", "root", "far", "open", "tokens"), percent)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (one row of each component, that of the smallest id) for each document row.

    key: a column of longs of docs that is handed through.
    """
    docs = docs.select("doc_id", "text", (F.lit(None).cast("long") if key is None else F.col(f"`{key}`")).alias("key"))
    all_sets = materialize(describe(docs, shingle, percent), "sets")
    # a null id comes after all others
    low = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("row"))
    # one row for each distinct set: the copy with the smallest row number stands for it
    best = all_sets.where("n > 0").groupBy("f1", "f2").agg(F.min("row").alias("rep"), F.min(low).alias("low"), F.min_by(F.struct("doc_id", "n", "cls", "prefix"), "row").alias("x"))
    distinct = materialize(best.select("f1", "f2", "rep", "low", "x.*"), "distinct")
    counted = postings(distinct).groupBy("t").agg(F.count("*").alias("c"))
    hot = bloom_of(materialize(counted.where(F.col("c") > HOT).select("t"), "hot"), "t")
    warm = materialize(warm_sets(distinct, hot), "warm")
    cooler = materialize(cooler_prefixes(docs, warm, hot, shingle, percent), "cooler")
    lists = postings(distinct.join(merge(warm.select("rep")), "rep", "left_anti").select("rep", "n", "cls", "prefix").unionByName(cooler))
    groups = materialize(relations(lists, percent), "groups")
    # a block holds at most BLOCK_SETS sets and BLOCK_BYTES bytes; sets of a band are of one or two size classes
    most = F.pow(F.lit(1 / (percent / 100 - 1e-4)), F.col("band") + 1) * 8
    fits = F.greatest(F.lit(2), F.least(F.lit(BLOCK_SETS), F.floor(BLOCK_BYTES / most)))
    sized = joined_back(groups, ["leader", "band"], "rep", {"p": F.count("*")}, {"c": F.sum("p")})
    groups = materialize(sized.select("leader", "band", "rep", F.ceil(F.col("c") / fits).alias("nb"), fits.alias("fits")), "sized")
    small = groups.where("nb = 1").join(merge(distinct.select("rep", "n", "prefix")), "rep").select("leader", "band", "rep", "n", "prefix")
    parts = materialize(survivors(small, percent), "parts")
    big = groups.where("nb > 1")
    spread = big.select("leader", "band", F.pmod(F.xxhash64("rep"), F.col("nb")).alias("sub"), "rep")
    blocks = parts.unionByName(spread)
    wanted = materialize(distinct.select("rep", "doc_id", "f1", "f2").join(merge(blocks.select("rep").distinct()), "rep"), "wanted")
    sets = materialize(fetch(docs, wanted, shingle), "tokens")
    edges = materialize(compare_within(blocks.join(merge(sets.select("rep", "tokens")), "rep").select("leader", "band", "sub", "rep", "tokens"), percent), "links")
    if not big.isEmpty():
        edges = edges.unionByName(materialize(big_group_links(big, sets, edges, percent), "across"))
    roots = components(edges)
    labels = distinct.select("f1", "f2", "rep", "low").join(merge(roots.withColumnRenamed("node", "rep")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lowest = labels.groupBy("root").agg(F.min("low").alias("low"))
    found = labels.drop("low").join(merge(lowest), "root").select("f1", "f2", "low")
    out = all_sets.select("row", "key", "doc_id", "n", "f1", "f2").join(merge(found), ["f1", "f2"], "left")
    component = F.when((F.col("n") > 0) & (F.col("low.id") < (1 << 63) - 1), F.col("low.id")).otherwise(F.col("doc_id"))
    kept = (F.col("n") == 0) | (F.col("low.row") == F.col("row"))
    return out.select(*([] if key is None else [F.col("key").alias(key)]), "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_only(spark, lambda: jaccard_components(table(spark, sf_dir, "documents")).drop("kept"), "components")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(w[i:i + 3]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.x = w.doc_id
"""
