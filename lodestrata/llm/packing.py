"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm on islands that exchange elites.

Documents are dealt by a hash to shards of about shard_items, so no source or length is hot. Each shard is evolved on ISLANDS
islands, each with a population of packings of its own. A crossover injects whole well-filled bins of one parent into the
other, takes out the bins that hold a document twice, and puts the displaced documents back best fit, longest first. Every island
runs at least MIN_GENERATIONS in each of EPOCHS epochs, and up to MAX_GENERATIONS while it has more bins than its lower bound. After
an epoch each island sends its elite, its best packing, to the next island of its shard, where it joins the population.

The best elite of a shard is kept: its bins that are full to within slack tokens are settled, and the documents of the others
go, with their bins as a first individual, to the fewer shards of the next level. The rows left shrink by a large factor each
level, so the last, single shard is small at any corpus size. Every epoch is a table in the shared folder.

Token ids are those of the byte-level BPE file byte_bpe_50k.json as the tokenizers library gives them with its default settings,
so the text of an added token (<|endoftext|>) in a document is that token. They are made by tiktoken from the same vocabulary
(byte_bpe_50k.tiktoken and the added tokens of the file), four times as fast and with equal ids (tests/llm holds both against
each other); a text that tiktoken refuses is encoded by tokenizers.

Defined cases: a null or empty text is the separator alone; repeated rows are packed as often as they occur; a text longer
than a sequence is cut into whole sequences after a first piece that takes the remainder; an empty table gives no rows; further
columns are ignored. A text is encoded whole, in memory of about ten times its bytes; batches hold about 2 MB of other texts.
"""

from __future__ import annotations

import base64
import json
import zlib
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import last_only, materialize, table, tidy

CAPACITY, SEPARATOR = 2048, 0
SHARD_ITEMS, SLACK, LEVELS = 2048, 2, 8
ISLANDS, EPOCHS, POPULATION, MIN_GENERATIONS, MAX_GENERATIONS = 2, 2, 4, 3, 10
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class Encoder:
    """Texts to token ids, without the special tokens that a model would add."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        import public_tokenizers as P
        import tiktoken

        with open(P.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.file, self.slow = P.path(vocabulary), None
        with open(self.file, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding("packing", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # a text beyond the regex engine's stack
            return self.encode_slow(text)

    def encode_slow(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes the remainder, the others are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; with_ids also keeps the token ids."""
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def encode(batches):
        encoder, number = Encoder(), 0
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), SEPARATOR).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = (number, doc_id, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32))
                    for c, x in zip(cols, row, strict=False):
                        c.append(x)
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    out = docs.select("doc_id", "text").mapInArrow(tidy(encode), PIECES_DDL + (", ids array<int>" if with_ids else ""))
    return out.withColumn("item", F.spark_partition_id() * F.lit(1 << 33) + F.col("item"))


class Packing:
    """An individual: documents in bins. Free space is kept as one integer with a bit for each amount that some bin has."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.free: dict[int, int] = {}
        self.by_free: dict[int, set[int]] = {}
        self.mask, self.next = 0, 0

    def _file(self, b: int, free: int) -> None:
        self.free[b] = free
        held = self.by_free.setdefault(free, set())
        if not held:
            self.mask |= 1 << free
        held.add(b)

    def _unfile(self, b: int) -> None:
        held = self.by_free[self.free[b]]
        held.discard(b)
        if not held:
            self.mask &= ~(1 << self.free[b])

    def open(self, items: list[int]) -> None:
        b, self.next = self.next, self.next + 1
        self.bins[b] = list(items)
        self._file(b, self.capacity - sum(self.sizes[i] for i in items))

    def take_out(self, b: int) -> list[int]:
        self._unfile(b)
        del self.free[b]
        return self.bins.pop(b)

    def best_fit(self, items: list[int]) -> None:
        sizes, by_free = self.sizes, self.by_free
        for i in items:
            s = sizes[i]
            fits = self.mask >> s
            if fits:
                b = next(iter(by_free[s + (fits & -fits).bit_length() - 1]))
                self._unfile(b)
                self.bins[b].append(i)
                self._file(b, self.free[b] - s)
            else:
                self.open([i])

    def copy(self) -> Packing:
        out = Packing(self.sizes, self.capacity)
        for items in self.bins.values():
            out.open(items)
        return out

    def fitness(self) -> tuple[int, float]:
        """Fewer bins, then fuller ones (the mean square of their fill)."""
        c = self.capacity
        return -len(self.bins), sum(((c - f) / c) ** 2 for f in self.free.values())


def longest_first(sizes: list[int], items) -> list[int]:
    return sorted(items, key=lambda i: (-sizes[i], i))


def crossover(a: Packing, b: Packing, rng: Random) -> Packing:
    """Whole well-filled bins of a go into b; b's bins that share a document with them dissolve."""
    ranked = sorted(a.bins, key=lambda k: (a.free[k], k))
    chosen = [k for k in ranked[: max(1, len(ranked) * 3 // 4)] if rng.random() < 0.5] or ranked[:1]
    child = b.copy()
    where = {i: k for k, items in child.bins.items() for i in items}
    injected = {i for k in chosen for i in a.bins[k]}
    displaced = []
    for k in {where[i] for i in injected}:
        displaced += [i for i in child.take_out(k) if i not in injected]
    for k in chosen:
        child.open(a.bins[k])
    child.best_fit(longest_first(child.sizes, displaced))
    return child


def mutate(p: Packing, rng: Random, share: float = 0.05) -> Packing:
    """The emptiest bins and a few others dissolve, and their documents go back best fit."""
    ranked = sorted(p.bins, key=lambda k: (-p.free[k], k))
    n = max(2, int(len(ranked) * share))
    loose: list[int] = []
    for k in {*ranked[:n], *(rng.choice(ranked) for _ in range(n))}:
        loose += p.take_out(k)
    p.best_fit(longest_first(p.sizes, loose))
    return p


def arrived(sizes: list[int], groups: list[int], capacity: int) -> Packing:
    """The packing that rows came with: the bin of each document, or -1 for a loose one."""
    bins: dict[int, list[int]] = {}
    for i, g in enumerate(groups):
        bins.setdefault(g, []).append(i)
    p, loose = Packing(sizes, capacity), bins.pop(-1, [])
    for items in bins.values():
        if sum(sizes[i] for i in items) <= capacity:
            p.open(items)
        else:
            loose += items
    p.best_fit(longest_first(sizes, loose))
    return p


def evolve(sizes: list[int], immigrants: list[list[int]] = (), capacity: int = CAPACITY, seed: int = 0, population: int = POPULATION, least: int = MIN_GENERATIONS, most: int = MAX_GENERATIONS) -> Packing:
    """One epoch of an island: the best packing of a population that starts with the immigrants (a bin for each document)."""
    rng, n = Random(seed), len(sizes)
    bound = -(-sum(sizes) // capacity)
    pool = [arrived(sizes, g, capacity) for g in immigrants]
    if len(pool) < population:
        p = Packing(sizes, capacity)
        p.best_fit(longest_first(sizes, range(n)))
        pool.append(p)
    while len(pool) < population:
        p = Packing(sizes, capacity)
        p.best_fit(sorted(range(n), key=lambda i: -sizes[i] * (0.7 + 0.3 * rng.random())))
        pool.append(p)
    pool.sort(key=Packing.fitness, reverse=True)
    for generation in range(most):
        if generation >= least and len(pool[0].bins) <= bound:
            break
        children = []
        for _ in range(population - 1):
            a, b = rng.sample(range(len(pool)), 2) if len(pool) > 1 else (0, 0)
            children.append(mutate(crossover(pool[a], pool[b], rng), rng))
        pool = sorted(pool + children, key=Packing.fitness, reverse=True)[:population]
    return pool[0]


#: What a row of an island carries besides the item: where it is, and the bins of the individuals that start there (-1: none).
STATE = {"shard": "long", "island": "int", "role": "int", "bin": "long"}


def individuals(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[list[int]]]:
    """The items of a group, in order, and the bins of each individual that arrived (own elite, the neighbour's)."""
    parts = [p.sort_values("item", kind="stable") for _, p in pdf.groupby("role", sort=True)]
    return parts[0].reset_index(drop=True), [p["bin"].tolist() for p in parts]


def epoch(capacity: int, number: int, islands: int):
    """The function of one island for one epoch: its elite stays and a copy of it goes to the next island."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, came = individuals(pdf)
        shard, island = int(items["shard"].iloc[0]), int(items["island"].iloc[0])
        best = evolve(items["length"].tolist(), [g for g in came if any(b >= 0 for b in g)], capacity, seed=(shard * islands + island) * 1009 + number)
        bins = np.empty(len(items), np.int64)
        for k, members in enumerate(best.bins.values()):
            bins[members] = k
        stay = items.assign(bin=bins, role=0)
        return pd.concat([stay, stay.assign(island=(island + 1) % islands, role=1)]) if islands > 1 else stay

    return run


def settle(names: list[str], capacity: int, slack: int, level: int, last: bool):
    """The function of one shard: the best elite of its islands, with the places of its documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rivals = []
        for _, p in pdf.groupby("island", sort=True):
            p = p.sort_values("item", kind="stable").reset_index(drop=True)
            rivals.append((p, arrived(p["length"].tolist(), p["bin"].tolist(), capacity)))
        items, best = max(rivals, key=lambda r: r[1].fitness())
        shard, sizes = int(items["shard"].iloc[0]), items["length"].tolist()
        sequence, offset, settled = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), np.zeros(len(items), bool)
        for k, members in enumerate(best.bins.values()):
            at = 0
            for i in sorted(members):
                sequence[i], offset[i] = (level << 56) | (shard << 16) | k, at
                at += sizes[i]
            settled[members] = last or capacity - at <= slack
        return items[names].assign(bin=sequence, sequence_id=sequence, offset=offset, settled=settled)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, slack: int = SLACK, levels: int = LEVELS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Add sequence_id and offset to rows of (item, length, ...); item is unique, lengths are 1 to capacity."""
    full = items.where(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.col("item"), "offset": F.lit(0).cast("long")})
    done, left = [full], items.where(F.col("length") < capacity).withColumn("bin", F.lit(-1).cast("long"))
    names = items.columns
    state_schema = items.withColumns({n: F.lit(0).cast(t) for n, t in STATE.items()}).schema
    out_schema = items.withColumns({"bin": F.lit(0).cast("long"), "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "settled": F.lit(True)}).schema
    before = None
    for level in range(levels):
        n = left.count()
        if not n:
            break
        shards = max(1, round(n / shard_items))
        last = level == levels - 1 or n == before or shards == 1
        before = n
        # the documents of a bin move together: they are dealt by its number, a loose one by its item
        key = F.when(F.col("bin") < 0, F.col("item")).otherwise(F.col("bin"))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64(key, F.lit(level)), F.lit(shards)))
        state = dealt.withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(islands))))).withColumn("role", F.lit(0)).select(*names, *STATE)
        for number in range(epochs):
            state = materialize(state.groupBy("shard", "island").applyInPandas(epoch(capacity, level * epochs + number, islands), state_schema), f"level{level}")
        found = materialize(state.where("role = 0").groupBy("shard").applyInPandas(settle(names, capacity, slack, level, last), out_schema), f"settled{level}")
        done.append(found.where("settled").select(*names, "sequence_id", "offset"))
        left = found.where("not settled").select(*names, "bin")
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return last_only(docs.sparkSession, lambda: pack(materialize(pieces(docs, capacity), "pieces"), capacity).drop("item"), "packed")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
