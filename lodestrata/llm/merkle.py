"""Merkle manifest of a table: a digest for each row, a tree for each language, a tree over those, and a proof for each row.

Every ARITY consecutive nodes become one, level by level. Leaves are numbered within their language by ranges of the order
(operators.ordered), so a language that holds most rows is many tasks, and cut into aligned blocks of ARITY ** LEVELS leaves.
A block is packed into one row with its root, which a stack of unfinished runs gives leaf by leaf. The roots are the leaves
of the same step one storey higher, until each language is a single block; their roots are packed likewise, in order of
language. On the way down each block gets the path that all its leaves share, from its root to the root of everything, and
a traversal goes through its leaves: each level keeps the run that the present leaf lies under, and a stack that has
just taken in the leaf one run ahead, so the next run is whole at the moment that it is needed. A level holds two runs
and its stack, whatever the size of the block: memory grows with the logarithm.

Defined cases: nulls of any column are hashed as `-`; rows with a null doc_id come first in their language, rows of equal
doc_id by their digest, and equal rows have equal leaves, whose proofs are those of the places they stand at; a row without
doc_id is not tampered with; an empty table gives no rows; further columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import last_only, materialize, merge, table
from lodestrata.operators.ordered import beside, running_totals

ARITY, LEVELS, TAMPERED = 8, 4, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[bytes]) -> bytes:
    """H of hex digests, as hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Treehash:
    """A stack of unfinished runs, one for each level: takes leaves, one at a time, and gives each node when it is whole."""

    def __init__(self, top: int):
        self.runs: list[list[bytes]] = [[] for _ in range(top)]
        self.done: list[bytes] = []  # nodes of level top, at most a run of them

    def push(self, node: bytes, level: int = 0) -> None:
        while level < len(self.runs):
            run = self.runs[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node, self.runs[level] = digest(run), []
            level += 1
        self.done.append(node)

    def close(self) -> list[bytes]:
        """The nodes of level top, with what is unfinished below taken as runs that end here."""
        for level, run in enumerate(self.runs):
            if run:
                self.runs[level] = []
                self.push(digest(run), level + 1)
        out, self.done = self.done, []
        return out


def height(leaves: int, total: int, most: int = LEVELS) -> int:
    """Levels of a block of the tree over total leaves: most, or fewer where the block is the tree."""
    if total > ARITY**most:
        return most
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def root_of(leaves: list[bytes], total: int, most: int = LEVELS) -> bytes:
    stack = Treehash(height(len(leaves), total, most))
    for leaf in leaves:
        stack.push(leaf)
    return stack.close()[0]


def traverse(leaves: list[bytes], total: int, most: int = LEVELS):
    """For each leaf in turn its path within the block: (place in its run, that run), level by level."""
    levels = height(len(leaves), total, most)
    spans = [ARITY ** (h + 1) for h in range(levels)]
    now, ahead = [], []
    for h, span in enumerate(spans):
        stack = Treehash(h)
        for leaf in leaves[:span]:
            stack.push(leaf)
        now.append(stack.close())
        ahead.append(Treehash(h))
    for i in range(len(leaves)):
        for h, span in enumerate(spans):
            if i and i % span == 0:
                now[h] = ahead[h].close()
            if i + span < len(leaves):
                ahead[h].push(leaves[i + span])
        yield [(i // ARITY**h % ARITY, now[h]) for h in range(levels)]


def fold(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root over leaf and the siblings of a path."""
    for at, run in path:
        leaf = digest([*run[:at], leaf, *run[at + 1 :]])
    return leaf


def hashed(text: Column) -> Column:
    """The digest of a row of FIELDS, with text in the place of its own."""
    given = {c: F.col(c).cast("string") for c in FIELDS} | {"text": text}
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in given.values())), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """row, branch (the language, such that null sorts first), doc_id, leaf, seen (null where nothing was changed) for each row."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("branch"), F.col("doc_id").cast("long").alias("id"), hashed(F.col("text")).alias("leaf"), F.when(touched, hashed(lowered)).alias("seen"))


BLOCK = "branch string, block long, total long, root binary, ids array<long>, leaves binary, seen array<binary>"


def pack(placed: DataFrame, most: int) -> DataFrame:
    """Rows (branch, place, total, id, leaf, seen) as aligned blocks, with their roots."""

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by("place").combine_chunks()
        own, total = group.column("leaf").to_pylist(), group.column("total")[0].as_py()
        root = bytes.fromhex(root_of([x.hex().encode() for x in own], total, most).decode())
        columns = [[group.column("branch")[0].as_py()], [group.column("block")[0].as_py()], [total], [root], [group.column("id").to_pylist()], [b"".join(own)], [group.column("seen").to_pylist()]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["branch", "block", "total", "root", "ids", "leaves", "seen"])

    # a group has ARITY ** most rows at most
    return placed.withColumn("block", F.floor(F.col("place") / ARITY**most)).groupBy("branch", "block").applyInArrow(block, BLOCK)


def storeys(rows: DataFrame, name: str, most: int) -> list[DataFrame]:
    """Packed blocks of rows (branch, place, total, id, leaf, seen), then of their roots, until each branch is one block."""
    out = []
    while True:
        out.append(materialize(pack(rows, most), name))
        if (out[-1].agg(F.max("total")).first()[0] or 0) <= ARITY**most:
            return out
        rows = out[-1].select("branch", F.col("block").alias("place"), F.ceil(F.col("total") / ARITY**most).alias("total"), F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("seen"))


STEP = "array<struct<at:int,run:binary>>"
UP = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.binary())]))


def paths(blocks: DataFrame, upper: DataFrame, most: int) -> DataFrame:
    """(branch, place, up) of the leaves of a storey that is not the lowest; upper: (branch, block, up) of its blocks."""

    schema = pa.schema([("branch", pa.string()), ("place", pa.int64()), ("up", UP)])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, up = _split(row["leaves"]), []
                for path in traverse(own, row["total"], most):
                    up.append([{"at": at, "run": bytes.fromhex(b"".join(r).decode())} for at, r in path] + row["up"])
                yield pa.RecordBatch.from_arrays([pa.array([row["branch"]] * len(own), pa.string()), pa.array(range(row["block"] * ARITY**most, row["block"] * ARITY**most + len(own)), pa.int64()), pa.array(up, UP)], schema=schema)

    return _with_upper(blocks, upper).mapInArrow(run, f"branch string, place long, up {STEP}")


def _split(raw: bytes) -> list[bytes]:
    text = raw.hex().encode()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def _with_upper(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    return merge(blocks).join(upper.select("branch", "block", "up"), ["branch", "block"])


def proofs(blocks: DataFrame, upper: DataFrame, most: int) -> DataFrame:
    """branch, doc_id, leaf, proof_sha256, folded_root of the lowest storey: each leaf's own path, then the shared one."""
    names = ["branch", "doc_id", "leaf", "proof_sha256", "folded_root"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = _split(row["leaves"])
                shared = [(s["at"], _split(s["run"])) for s in row["up"]]
                tail = b"".join(b"".join([*r[:at], *r[at + 1 :]]) for at, r in shared)
                proof, folded = [], []
                for leaf, seen, path in zip(own, row["seen"], traverse(own, row["total"], most), strict=True):
                    proof.append(digest([*(x for at, r in path for k, x in enumerate(r) if k != at), tail]).decode())
                    folded.append(fold(leaf if seen is None else seen.hex().encode(), [*path, *shared]).decode())
                yield pa.RecordBatch.from_arrays([pa.array([row["branch"]] * len(own), pa.string()), pa.array(row["ids"], pa.int64()), pa.array([x.decode() for x in own]), pa.array(proof), pa.array(folded)], names=names)

    return _with_upper(blocks, upper).mapInArrow(run, "branch string, doc_id long, leaf string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs, by blocks of ARITY ** levels leaves."""
    rows = materialize(leaves(docs), "leaves")
    counts = rows.groupBy("branch").agg(F.count("*").alias("total"))
    placed = running_totals(rows, ["branch"], [F.col("id"), F.col("leaf"), F.col("row")], {"place": F.lit(1)}, materialize)
    trees = storeys(beside(placed, counts, ["branch"]), "blocks", levels)
    # the roots of the languages are the leaves of one more tree
    langs = trees[-1].select("branch", F.col("root").alias("leaf"))
    langs = materialize(running_totals(langs, [], [F.col("branch")], {"place": F.lit(1)}, materialize), "languages")
    nothing = {"branch": F.lit(""), "total": F.lit(langs.count()).cast("long"), "id": F.lit(None).cast("long"), "seen": F.lit(None).cast("binary")}
    tops = storeys(langs.select("place", "leaf", *(c.alias(n) for n, c in nothing.items())), "tops", levels)
    up = tops[-1].select("branch", "block", F.array().cast(STEP).alias("up"))
    for blocks in reversed(tops):
        up = materialize(paths(blocks, up, levels), "paths").withColumnRenamed("place", "block")
    up = langs.join(merge(up), F.col("place") == F.col("block")).select(langs["branch"], F.lit(0).cast("long").alias("block"), "up")
    for blocks in reversed(trees[1:]):
        up = materialize(paths(blocks, up, levels), "paths").withColumnRenamed("place", "block")
    root = (tops[-1].select("root").first() or [b""])[0]
    ends = langs.select("branch", F.lower(F.hex("leaf")).alias("subroot"), F.lit(root.hex()).alias("root"))
    out = beside(materialize(proofs(trees[0], up, levels), "proofs"), ends, ["branch"])
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_only(spark, lambda: manifest(table(spark, sf_dir, "documents")), "manifest")


#: crc32 bit by bit, and the two kinds of trees level by level.
ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM documents
), crc AS (
  SELECT r, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS c
  FROM d WHERE doc_id IS NOT NULL
), leafs AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN c % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen
  FROM d LEFT JOIN crc USING (r)
), placed AS (
  SELECT *, coalesce('=' || lang, '-') AS branch, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leafs
), nodes(branch, level, place, n, h) AS (
  SELECT branch, 0, place, n, leaf FROM placed
  UNION ALL SELECT branch, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY branch, level, place // 8, n
), subroots AS (
  SELECT branch, h AS subroot, row_number() OVER (ORDER BY branch) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, place, n, h) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 8, n
), every AS (
  SELECT branch, level, place, n, h FROM nodes UNION ALL SELECT '', level, place, n, h FROM tops
), sides AS (
  SELECT branch, level, place, n,
    coalesce(string_agg(h, '') OVER (PARTITION BY branch, level, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(h, '') OVER (PARTITION BY branch, level, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM every
), climb(r, branch, level, place, n, h, proof) AS (
  SELECT r, branch, 0, place, n, seen, '' FROM placed
  UNION ALL SELECT c.r, c.branch, c.level + 1, c.place // 8, (c.n + 7) // 8, sha256(s.lft || c.h || s.rgt), c.proof || s.lft || s.rgt
  FROM climb c JOIN sides s ON s.branch = c.branch AND s.level = c.level AND s.place = c.place WHERE c.n > 1
), above(r, level, place, n, h, proof) AS (
  SELECT c.r, 0, s.place, s.n, c.h, c.proof FROM climb c JOIN subroots s USING (branch) WHERE c.n = 1
  UNION ALL SELECT c.r, c.level + 1, c.place // 8, (c.n + 7) // 8, sha256(s.lft || c.h || s.rgt), c.proof || s.lft || s.rgt
  FROM above c JOIN sides s ON s.branch = '' AND s.level = c.level AND s.place = c.place WHERE c.n > 1
)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(a.proof) AS proof_sha256, a.h AS folded_root, a.h = t.h AS verified
FROM placed p JOIN subroots s USING (branch) JOIN above a ON a.r = p.r AND a.n = 1 CROSS JOIN (SELECT h FROM tops WHERE n = 1) t
"""
