"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: each block holds the texts of a few megabytes of documents as one row, with the
flat positions of every term in ascending order. It is stored once, whatever is searched for later. A search intersects, for each
phrase, the posting lists of its terms after taking off each term's offset in the phrase, starting from the term that is rarest in
the block; what is left are the exact phrase matches. Proximity search intersects windows of positions in the same way.

Blocks never meet in a shuffle, so no term, source or group of copies can be hot, and a lost executor costs its blocks
alone. Test items are taken in chunks of a bounded number of bytes (chunk_bytes, broadcast one by one), so that the size
of the benchmark is no limit. A block's terms lead the search: each phrase is filed under the term that is rarest in the
benchmark, and a block looks only at the phrases that are filed under its own terms.

Defined cases: a null or empty text has no words; an item without words, or without an id, matches nothing; repeated rows each
get their own result; several items with one id count once; other columns of the inputs are ignored. A text is indexed whole, in
memory of about thirty times its bytes; other texts share blocks of block_bytes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, table, text_slices, tidy
from lodestrata.llm.words import ALNUM, find_words, ranges, word_hashes

WINDOW, CHUNK_BYTES, BLOCK_BYTES = 10, 8 << 20, 1 << 20
SLICE = 1 << 20  # words of phrases looked up at once

INDEX = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int32())),
    ("terms", pa.list_(pa.int64())), ("heads", pa.list_(pa.int32())), ("postings", pa.list_(pa.int32())),
])
INDEX_DDL = "block long, doc_ids array<long>, bounds array<int>, terms array<long>, heads array<int>, postings array<int>"


def item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and bounds by text."""
    _, _, raw, offsets = next(text_slices(pa.array(texts, pa.string()), 1 << 62))
    b, starts, lengths, bounds = find_words(raw, offsets, ALNUM)
    return word_hashes(b, starts, lengths), bounds


def item_chunks(items: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """The test items in chunks of about chunk_bytes of text: ids as strings, word hashes and bounds."""
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    for i, t in rows.toLocalIterator():
        if texts and size + len(t) > chunk_bytes:
            yield ids, *item_words(texts)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if texts:
        yield ids, *item_words(texts)


def windows(h: np.ndarray, bounds: np.ndarray, window: int):
    """Phrases of items: window consecutive words, or all words of a shorter item. (first word, words, item)"""
    counts = np.diff(bounds)
    n = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
    return ranges(bounds[:-1], n), np.repeat(np.minimum(counts, window), n), np.repeat(np.arange(len(n)), n)


class Phrases:
    """Phrases h[first:first+words] to search for, each filed under the term of it that is rarest among all of them.

    Made once for each task. A block then finds its phrases from its own terms, so that it costs its terms and the phrases
    they lead to, and not the words of the benchmark.
    """

    def __init__(self, h: np.ndarray, first: np.ndarray, words: np.ndarray):
        self.first, self.words = first, words
        self.terms, self.code, count = np.unique(h, return_inverse=True, return_counts=True)
        some = np.flatnonzero(words > 0)
        if len(some):
            key = np.append(count[self.code] * len(self.terms) + self.code, 0)
            # least key of each phrase: every other segment is one, and phrases may overlap
            lead = np.minimum.reduceat(key, np.stack([first[some], first[some] + words[some]], axis=1).ravel())[::2] % len(self.terms)
            order = np.argsort(lead, kind="stable")
            some, lead = some[order], lead[order]
        else:
            lead = some
        self.led, self.heads = some, np.searchsorted(lead, np.arange(len(self.terms) + 1))


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block of documents, with the postings of all terms; stored in the shared folder."""

    def index(batches):
        number = 0
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, raw, offsets in text_slices(batch.column("text"), block_bytes):
                b, starts, lengths, bounds = find_words(raw, offsets, ALNUM)
                h = word_hashes(b, starts, lengths)
                # a gap of one position after each document keeps phrases from crossing into the next
                place = (np.arange(len(h)) + np.repeat(np.arange(hi - lo), np.diff(bounds))).astype(np.int32)
                order = np.argsort(h, kind="stable")
                h = h[order]
                heads = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)) if len(h) else np.zeros(1, np.int64)
                row = [[number], [ids[lo:hi].to_pylist()], [(bounds + np.arange(hi - lo + 1)).astype(np.int32)], [h[heads[:-1]].view(np.int64)], [heads.astype(np.int32)], [place[order]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, INDEX, strict=True)], schema=INDEX)
                number += 1

    rows = docs.select("doc_id", "text").mapInArrow(tidy(index), INDEX_DDL)
    return materialize(rows.withColumn("block", F.spark_partition_id() * F.lit(1 << 33) + F.col("block")), "postings")


class Block:
    """One block of the index, opened for searching."""

    def __init__(self, row: dict):
        self.doc_ids, self.bounds = row["doc_ids"], row["bounds"].astype(np.int64)
        self.terms, self.heads, self.postings = row["terms"].view(np.uint64), row["heads"].astype(np.int64), row["postings"].astype(np.int64)
        self.span = int(self.bounds[-1]) + 1
        # term by term ascending, so one sorted array holds all lists: list number * span + position
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.heads)) * self.span + self.postings

    def held(self, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases all of whose terms the block holds, ascending; the terms of wanted that it holds, and their lists."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(wanted.terms):
            return none, none, none
        k = np.minimum(np.searchsorted(wanted.terms, self.terms), len(wanted.terms) - 1)
        lists = np.flatnonzero(wanted.terms[k] == self.terms)
        codes = k[lists]
        led = wanted.led[ranges(wanted.heads[codes], np.diff(wanted.heads)[codes])]
        total, out = np.cumsum(wanted.words[led]), [none]
        for part in np.split(led, np.searchsorted(total, np.arange(SLICE, total[-1] if len(led) else 0, SLICE))):
            if len(part):
                n = wanted.words[part]
                c = wanted.code[ranges(wanted.first[part], n)]
                ok = codes[np.minimum(np.searchsorted(codes, c), len(codes) - 1)] == c
                out.append(part[np.logical_and.reduceat(ok, np.cumsum(n) - n)])
        return np.sort(np.concatenate(out)), codes, lists

    def phrases(self, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches of the wanted phrases: (phrase, position of its first word)."""
        alive, codes, numbers = self.held(wanted)
        first, words = wanted.first, wanted.words
        width = int(words[alive].max(initial=0))
        if not width:
            return alive, alive

        def lists(at: np.ndarray) -> np.ndarray:
            """The lists of the words at these places; any list for places behind the end of a phrase."""
            c = wanted.code[np.minimum(at, len(wanted.code) - 1)]
            return numbers[np.minimum(np.searchsorted(codes, c), len(codes) - 1)]

        at = first[alive, None] + np.arange(width)[None, :]
        inside = np.arange(width)[None, :] < words[alive, None]
        f = np.where(inside, np.diff(self.heads)[lists(at)], np.iinfo(np.int64).max)
        rarest = np.argsort(f, axis=1, kind="stable")
        phrase = np.repeat(np.arange(len(alive)), f[np.arange(len(alive)), rarest[:, 0]])
        lead = lists(first[alive] + rarest[:, 0])
        start = self.postings[ranges(self.heads[lead], np.diff(self.heads)[lead])] - rarest[phrase, 0]
        for step in range(1, width):  # intersect with the next rarest list, shifted by its term's offset
            off = rarest[phrase, step]
            more = step < words[alive[phrase]]
            key = lists(first[alive[phrase]] + off) * self.span + start + off
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = ~more | ((self.keys[k] == key) & (start + off < self.span) & (start >= 0))
            phrase, start = phrase[ok], start[ok]
            if not len(phrase):
                break
        return alive[phrase], start

    def near(self, lists: np.ndarray, slop: int) -> np.ndarray:
        """Positions from which a word of each of these lists, in any order, lies within slop words: proximity matches, by first position."""
        wanted, times = np.unique(lists, return_counts=True)
        order = np.argsort(np.diff(self.heads)[wanted], kind="stable")
        lead = self.postings[self.heads[wanted[order[0]]] : self.heads[wanted[order[0]] + 1]]
        start = np.unique(ranges(np.maximum(lead - slop + 1, 0), lead + 1 - np.maximum(lead - slop + 1, 0)))
        doc_end = self.bounds[np.searchsorted(self.bounds, start, "right")] if len(start) else start
        end = np.minimum(start + slop, doc_end)
        held = np.zeros(len(start), bool)
        for k in order:
            p = self.postings[self.heads[wanted[k]] : self.heads[wanted[k] + 1]]
            i, j = np.searchsorted(p, start), np.searchsorted(p, end)
            ok = j - i >= times[k]
            held |= (i < len(p)) & (p[np.minimum(i, len(p) - 1)] == start)
            start, end, held, = start[ok], end[ok], held[ok]
        return start[held]


def blocks_of(batches) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("bounds", "terms", "heads", "postings")}
            yield batch.column("block")[i].as_py(), Block(row | {"doc_ids": batch.column("doc_ids")[i].values})


HITS_DDL = "block long, ordinal int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
HITS = pa.schema([("block", pa.int64()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals that are sorted by start: each stretch of words once."""
    if not len(start):
        return start, end
    far = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > far[:-1])
    return start[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]


def search(index: DataFrame, chunk: tuple[list, np.ndarray, np.ndarray], window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Exact matches of all windows of a chunk of items: for each document the word intervals hit and the items found, or their digest.

    The digest is made by the worker that searches, as a second Python step in a stage would take a second worker.
    """
    held = index.sparkSession.sparkContext.broadcast(chunk)

    def find(batches):
        names, h, item_bounds = held.value
        first, words, item = windows(h, item_bounds, window)
        wanted = Phrases(h, first, words)
        for block, b in blocks_of(batches):
            phrase, start = b.phrases(wanted)
            order = np.argsort(start, kind="stable")
            phrase, start = phrase[order], start[order]
            end = start + words[phrase]
            cut = np.searchsorted(start, b.bounds)
            n = len(b.bounds) - 1
            starts, ends, items = [[]] * n, [[]] * n, [[]] * n
            for d in np.flatnonzero(np.diff(cut)):
                s, e = joined(start[cut[d] : cut[d + 1]] - b.bounds[d], end[cut[d] : cut[d + 1]] - b.bounds[d])
                starts[d], ends[d] = s.astype(np.int32), e.astype(np.int32)
                items[d] = [names[k] for k in np.unique(item[phrase[cut[d] : cut[d + 1]]])]
            cols = [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), b.doc_ids, pa.array(np.diff(b.bounds) - 1), starts, ends, items]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, HITS, strict=True)], schema=HITS)

    return index.mapInArrow(tidy((lambda batches: _digest(find(batches))) if digest else find), DIGEST_DDL if digest else HITS_DDL)


DIGEST_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(batches):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    for batch in batches:
        hit, count, sha = [], [], []
        empty = hashlib.sha256(b"").hexdigest()
        for s, e, items in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), batch.column("items").to_pylist(), strict=True):
            if s:
                order = np.argsort(s, kind="stable")
                s, e = joined(np.array(s)[order], np.array(e)[order])
            hit.append(int(np.sum(np.array(e, np.int64) - np.array(s, np.int64))))
            names = sorted(set(items))
            count.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest() if names else empty)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], schema=out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(docs)
    chunks = item_chunks(benchmark, chunk_bytes)
    chunk, second = next(chunks, ([], np.zeros(0, np.uint64), np.zeros(1, np.int64))), next(chunks, None)
    if second is None:
        return materialize(search(index, chunk, window, digest=True), "hits")
    hits = None
    for part in itertools.chain([chunk, second], chunks):
        found = materialize(search(index, part, window), "hits")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("block", "ordinal", "doc_id", "n_words").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
    return materialize(hits.select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(_digest, DIGEST_DDL), "digests")


NEAR = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("position", pa.int64())])


def near_matches(docs: DataFrame, items: DataFrame, slop: int, chunk_bytes: int = CHUNK_BYTES, index: DataFrame | None = None) -> DataFrame:
    """Proximity matches: for each document and item the first words of spans of at most slop words that hold all the item's words.

    index: the index of docs, where one has been built.
    """
    index, out = build_index(docs) if index is None else index, None

    def finder(held):
        def find(batches):
            names, h, bounds = held.value
            wanted = Phrases(h, bounds[:-1], np.diff(bounds))
            for _, b in blocks_of(batches):
                items, codes, lists = b.held(wanted)
                for k in items:
                    start = b.near(lists[np.searchsorted(codes, wanted.code[bounds[k] : bounds[k + 1]])], slop)
                    d = np.searchsorted(b.bounds, start, "right") - 1
                    if len(start):
                        yield pa.RecordBatch.from_arrays([b.doc_ids.take(pa.array(d)), pa.array([names[k]] * len(start)), pa.array(start - b.bounds[d])], schema=NEAR)

        return find

    for chunk in item_chunks(items, chunk_bytes):
        found = materialize(index.mapInArrow(finder(docs.sparkSession.sparkContext.broadcast(chunk)), "doc_id long, item_id string, position long"), "near")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id string, position long") if out is None else out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, w[i:i + least(len(w), 10) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT k FROM win), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw WHERE len(w) > 0
), grams AS (
  SELECT doc_id, i, k, w[i:i + k - 1] AS g FROM pos, lens WHERE i + k - 1 <= len(w)
), found AS (
  SELECT doc_id, i, k, item_id FROM grams JOIN win USING (k, g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
