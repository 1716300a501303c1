"""Repeated passages by a sparse suffix array.

Only suffixes that start at a minimiser are kept: the position whose K-word hash is the smallest of WINDOW consecutive ones.
Which positions those are depends on the words alone, so equal passages keep the same suffixes. Suffixes whose first K words
occur once are dropped; the others are sorted by their words over the whole corpus, each is compared with its NEIGHBOURS
nearest suffixes of other documents on either side, and each match is extended to the left and right.

A span of MIN_WORDS or more words that a document shares with another is a repeat. The context that a suffix carries
(MIN_WORDS to the right, MIN_WORDS - K to the left) is as long as it need be: every stretch of MIN_WORDS words holds a suffix, at
the same place in each document that has the stretch, and the spans found from them are joined.

The neighbours are all there is for a key with few suffixes. Where a key has more, or several in a row of one document, a suffix
that agrees longer to the left may stand far off, so such keys are also compared exactly: for each l, suffixes with the same
MIN_WORDS words from l before them (128 bits) are grouped. Groups are formed within a range; only for the keys at the ends of a
range, which may go on in the next one, are two suffixes of each group (or the one there is) grouped again over all ranges. So
every repeat is found whole, whatever the number of suffixes of a key and wherever the ranges end.

The sort is a range partitioning by words and document, so suffixes of one passage spread over as many tasks as their number asks
for. Documents of equal words are one document for the sort, and each of them repeats the others whole.

With `within`, stretches of MIN_WORDS words that stand at several places of one document are repeats too: they are found where the
document is scanned, and other_id is then the document itself.

Defined cases: words are those of the Jaccard join (A-Z folded, split at white space); a null or shorter text has no repeats; rows
with equal or null ids are documents of their own, told apart by a key of the row; further columns are ignored; documents without
repeats have no row. A text is read whole, in memory of about forty times its bytes; batches hold about 2 MB of other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, merge, table, text_slices, tidy, with_row_key
from lodestrata.llm.words import SPACED, find_words, mix, ranges, shingles, word_hashes

MIN_WORDS, K, WINDOW, NEIGHBOURS = 50, 12, 25, 8
RANGE_ROWS = 60_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def minimisers(g: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Positions in g (hashes of K words, by document bounds) that are the smallest of some window; leftmost of equals."""
    low = np.uint64((1 << 20) - 1)
    n = len(g)
    if n < window:
        return np.zeros(0, np.int64)
    m = (g & ~low) | (np.arange(n, dtype=np.uint64) & low)
    span = 1
    while span * 2 <= window:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < window:
        m = np.minimum(m[: n - window + 1], m[window - span : window - span + n - window + 1])
    start = np.arange(len(m))
    doc = np.searchsorted(bounds, start, "right") - 1
    inside = start + window <= bounds[doc + 1]
    start, m = start[inside], m[inside]
    return np.unique(start + (((m & low).astype(np.int64) - start) & ((1 << 20) - 1)))


def word_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds) of runs of texts."""
    for lo, hi, raw, offsets in text_slices(column):
        b, starts, lengths, bounds = find_words(raw, offsets, SPACED, nul_is_word=True)
        yield lo, hi, word_hashes(b, starts, lengths), bounds


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each sequence of words."""
    place = (np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    out = []
    for step in (_A, _B):
        total = np.append(np.uint64(0), np.cumsum(mix(h ^ mix((place + np.uint64(1)) * step)), dtype=np.uint64))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


INNER = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("other_start", pa.int32())])
SCAN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64())), ("inner", pa.list_(INNER))])


def inner_repeats(h: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, start elsewhere) of the stretches of min_words words that a document holds at several places."""
    if len(h) <= min_words:
        return []
    g, _ = shingles(h, np.array([0, len(h)]), min_words)
    _, first, group, count = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[group] > 1)
    order = np.lexsort((-np.arange(len(g)), group))
    last = order[np.searchsorted(group[order], np.arange(len(count)))]
    other = np.where(first[group[at]] == at, last[group[at]], first[group[at]])
    return list(zip(at.tolist(), (at + min_words).tolist(), other.tolist(), strict=True))


def scan(docs: DataFrame, k: int, window: int, min_words: int, within: bool = False) -> DataFrame:
    """row, doc_id, number of words, fingerprint, and the distinct minimisers (hashes of k words) of each document of min_words and more.

    docs: row, doc_id, text. inner: the document's repeats within itself, if within.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, h, bounds in word_runs(batch.column("text")):
                f1, f2 = fingerprints(h, bounds)
                g, cut = shingles(h, bounds, k)
                at = minimisers(g, cut, window)
                counts = np.diff(bounds)
                doc = np.searchsorted(cut, at, "right") - 1
                at, doc = at[counts[doc] >= min_words], doc[counts[doc] >= min_words]
                heads = np.searchsorted(doc, np.arange(hi - lo + 1))
                keys = [np.unique(g[at[heads[i] : heads[i + 1]]]).view(np.int64) for i in range(hi - lo)]
                inner = [[dict(zip(INNER.names, r, strict=True)) for r in inner_repeats(h[a:b], min_words)] if within else [] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row")[lo:hi], batch.column("doc_id")[lo:hi], pa.array(counts.astype(np.int64)), pa.array(f1), pa.array(f2), pa.array(keys, pa.list_(pa.int64())), pa.array(inner, pa.list_(INNER))], schema=SCAN)

    return docs.mapInArrow(tidy(run), "row long, doc_id long, n long, f1 long, f2 long, keys array<long>, inner array<struct<start:int,end:int,other_start:int>>")


SUFFIX_DDL = "key long, right binary, left binary, row long, doc_id long, has_left int, has_right int, places array<int>"
SUFFIX = pa.schema([("key", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("has_left", pa.int32()), ("has_right", pa.int32()), ("places", pa.list_(pa.int32()))])


def suffixes(docs: DataFrame, wanted: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """The suffixes of wanted keys (row, keys) with their words as 32-bit hashes: right from the place, left backwards.

    Places of a document with equal words around them are one suffix with several places.
    """
    reach = min_words - k

    def run(batches):
        for batch in batches:
            for lo, hi, h, bounds in word_runs(batch.column("text")):
                g, cut = shingles(h, bounds, k)
                every = minimisers(g, cut, window)
                heads = np.searchsorted(every, cut)
                # padded so that every context is whole; the lengths say how much of it is the document's
                w = np.concatenate([np.zeros(reach, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(min_words, np.uint32)])
                for i in range(hi - lo):
                    at = every[heads[i] : heads[i + 1]]
                    at = at[np.isin(g[at], batch.column("keys")[lo + i].values.to_numpy().view(np.uint64))]
                    if not len(at):
                        continue
                    place, n = at - cut[i], int(bounds[i + 1] - bounds[i])
                    here = bounds[i] + place + reach
                    whole = np.concatenate([w[here[:, None] + np.arange(min_words)], w[here[:, None] - 1 - np.arange(reach)], np.minimum(place, reach)[:, None].astype(np.uint32), np.minimum(n - place, min_words)[:, None].astype(np.uint32)], axis=1)
                    _, first, same = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
                    order = np.argsort(same, kind="stable")
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(same[order], np.arange(len(first) + 1)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
                    one = whole[first]
                    fixed = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
                    same_for_all = lambda c, i=i, lo=lo, m=len(first), batch=batch: batch.column(c)[lo + i : lo + i + 1].take(pa.array(np.zeros(m, np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(g[at[first]].view(np.int64)), fixed(one[:, :min_words]), fixed(one[:, min_words:-2]), same_for_all("row"), same_for_all("doc_id"), pa.array(one[:, -2].astype(np.int32)), pa.array(one[:, -1].astype(np.int32)), lists], schema=SUFFIX)

    # both sides have a row for each document at most, and both grow with the input
    joined = docs.join(merge(wanted.select("row", "keys")), "row")
    return joined.select("row", "doc_id", "keys", "text").mapInArrow(tidy(gathered(run, SUFFIX)), SUFFIX_DDL)


def gathered(run, schema: pa.Schema, rows: int = 5000):
    """run with its small batches put together."""

    def together(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return together


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns agree, row by row."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class Sorted:
    """Suffixes of one range, in order."""

    def __init__(self, t: pa.Table, k: int, min_words: int):
        number = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        words = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32).reshape(len(t), -1)
        self.key, self.row, self.has_left, self.has_right = number("key"), number("row"), number("has_left"), number("has_right")
        self.right, self.left = words("right"), words("left")
        self.doc_id, self.k, self.min_words = t.column("doc_id").combine_chunks(), k, min_words
        new = np.append(True, self.row[1:] != self.row[:-1])
        self.run, self.head = np.cumsum(new) - 1, np.flatnonzero(new)
        self.tail = np.append(self.head[1:], len(t)) - 1

    def total(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that the suffixes i and j agree on to the left and to the right."""
        right = np.minimum(agreement(self.right[i], self.right[j]), np.minimum(self.has_right[i], self.has_right[j]))
        left = np.minimum(agreement(self.left[i], self.left[j]), np.minimum(self.has_left[i], self.has_left[j]))
        return left, right

    def matches(self, neighbours: int) -> tuple[np.ndarray, ...]:
        """(suffix, left, right, other, other_left): how far the matches of min_words and more of each suffix reach, and the longest one's partner."""
        n = len(self.key)
        far_left, far_right, best, partner, back = (np.zeros(n, np.int64) for _ in range(5))
        for step in range(1, neighbours + 1):
            for ends, side in ((self.tail, -step), (self.head, step)):
                other = self.run + side
                i = np.flatnonzero((other >= 0) & (other < len(self.head)))
                j = ends[other[i]]
                near = (self.key[i] == self.key[j]) & (self.row[i] != self.row[j])
                i, j = i[near], j[near]
                left, right = self.total(i, j)
                long = (left + right >= self.min_words) & (right >= self.k)
                i, j, left, right = i[long], j[long], left[long], right[long]
                far_left[i], far_right[i] = np.maximum(far_left[i], left), np.maximum(far_right[i], right)
                more = left + right > best[i]
                best[i[more]], partner[i[more]], back[i[more]] = (left + right)[more], j[more], left[more]
        i = np.flatnonzero(best)
        return i, far_left[i], far_right[i], partner[i], back[i]

    def unsure(self, neighbours: int, outer: np.ndarray) -> np.ndarray:
        """Suffixes of the keys for which matches() need not have met every pair; all of a key's or none."""
        head = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1]))
        size = np.diff(np.append(head, len(self.key)))
        again = np.append(False, (self.row[1:] == self.row[:-1]) & (self.key[1:] == self.key[:-1]))
        return np.flatnonzero(np.repeat((size > neighbours + 1) | np.logical_or.reduceat(again, head) | outer[head], size))

    def shared(self, i: np.ndarray, whole: bool) -> np.ndarray:
        """The most words to the right that any suffix of another document can share with suffix i; the order puts that one next to its run."""
        most = np.zeros(len(i), np.int64)
        for ends, side in ((self.tail, -1), (self.head, 1)):
            other = self.run[i] + side
            inside = (other >= 0) & (other < len(self.head))
            j = ends[other[inside]]
            agree = np.where(self.key[i[inside]] == self.key[j], agreement(self.right[i[inside]], self.right[j]), 0)
            most[inside] = np.maximum(most[inside], agree)
            if not whole:
                most[~inside] = self.min_words
        return most

    def windows(self, i: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(l, 64 bits, 64 more) of the min_words words that begin l before each suffix i."""
        word = lambda side, at, salt: mix(side[i, at].astype(np.uint64) ^ salt)
        last = [np.uint64(pow(int(b), self.min_words - 1, 1 << 64)) for b in (_A, _B)]
        hashes = []
        for base in (_A, _B):
            h = np.zeros(len(i), np.uint64)
            for at in range(self.min_words - 1, -1, -1):
                h = h * base + word(self.right, at, base)
            hashes.append(h)
        for before in range(self.min_words - self.k + 1):
            yield before, *hashes
            if before < self.min_words - self.k:
                hashes = [(h - word(self.right, self.min_words - 1 - before, base) * top) * base + word(self.left, before, base) for h, base, top in zip(hashes, (_A, _B), last, strict=True)]

    def exact(self, neighbours: int, far_left: np.ndarray, far_right: np.ndarray, whole: bool) -> Iterator[tuple]:
        """What the neighbours of suffixes do not show, given how far their matches reach.

        Yields (l, suffix, wanted, 64 bits, 64 more) of windows that may have equals in other ranges (none if this range is the
        whole), and at the end (suffix, left, right, other): how far the windows shared within the range reach.
        """
        outer = np.zeros(len(self.key), bool) if whole else (self.key == self.key[0]) | (self.key == self.key[-1])
        at = self.unsure(neighbours, outer)
        at = at[(most := self.shared(at, whole)) >= self.k]
        most, row, outer = most[most >= self.k], self.row[at], outer[at]
        far_left, far_right, has_left, has_right = far_left[at], far_right[at], self.has_left[at], self.has_right[at]
        least, longest, partner = np.full(len(at), self.min_words), np.full(len(at), -1), np.zeros(len(at), np.int64)
        for before, h1, h2 in self.windows(at):
            behind = self.min_words - before
            o = np.flatnonzero((before <= has_left) & (behind <= np.minimum(has_right, most)))
            if not len(o):
                continue
            o = o[np.lexsort((row[o], h1[o]))]
            new = np.append(True, (h1[o[1:]] != h1[o[:-1]]) | (h2[o[1:]] != h2[o[:-1]]))
            group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            first, last = o[heads][group], o[np.append(heads[1:], len(o)) - 1][group]
            several = row[first] != row[last]
            wanted = (before > far_left[o]) | (behind > far_right[o])
            hit = several & wanted
            i = o[hit]
            least[i], longest[i] = np.minimum(least[i], before), before
            partner[i] = np.where(row[first] == row[o], last, first)[hit]
            sent = outer[o] & np.where(several, (o == first) | (o == last), wanted | (o == first))
            if sent.any():
                yield before, at[o[sent]], (wanted & ~several)[sent], h1[o[sent]].view(np.int64), h2[o[sent]].view(np.int64)
        i = np.flatnonzero(longest >= 0)
        yield at[i], longest[i], self.min_words - least[i], at[partner[i]]


MATCH_DDL = "row long, doc_id long, start int, end int, other_row long, other_id long, other_start int, w1 long, w2 long, wanted boolean"
MATCH = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("other_row", pa.int64()), ("other_id", pa.int64()), ("other_start", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("wanted", pa.bool_())])
FOUND = ("row", "doc_id", "start", "end", "other_row", "other_id", "other_start")


def sort_and_compare(found: DataFrame, parts: int, k: int, min_words: int, neighbours: int) -> DataFrame:
    """Matches within each range (w1 is null), and, where there are several ranges, windows that may have equals in others (w1, w2)."""

    def run(batches):
        t = pa.Table.from_batches(batches, SUFFIX)
        if not len(t):
            return
        s = Sorted(t, k, min_words)
        places = t.column("places").combine_chunks()
        values, heads = places.values.to_numpy(), places.offsets.to_numpy()

        def at_places(i, all_places=True):
            """For suffixes i: the number of each in i, and its place; a suffix with several places is found at each of them."""
            count = np.where(all_places, np.diff(heads)[i], 1)
            return np.repeat(np.arange(len(i)), count), values[ranges(heads[i].astype(np.int64), count.astype(np.int64))]

        def batch(i, start, end, other=None, other_start=None, w1=None, w2=None, wanted=None):
            given = {"row": s.row[i], "doc_id": s.doc_id.take(pa.array(i)), "start": start, "end": end, "other_start": other_start, "w1": w1, "w2": w2, "wanted": wanted}
            if other is not None:
                given |= {"other_row": s.row[other], "other_id": s.doc_id.take(pa.array(other))}
            return pa.RecordBatch.from_arrays([pa.nulls(len(i), f.type) if given.get(f.name) is None else x.cast(f.type) if isinstance(x := given[f.name], pa.Array) else pa.array(x.astype(f.type.to_pandas_dtype())) for f in MATCH], schema=MATCH)

        def spans(i, left, right, j, back):
            each, place = at_places(i)
            return batch(i[each], place - left[each], place + right[each], j[each], values[heads[j[each]]] - back[each])

        i, left, right, j, back = s.matches(neighbours)
        yield spans(i, left, right, j, back)
        far_left, far_right = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        far_left[i], far_right[i] = left, right
        for out in s.exact(neighbours, far_left, far_right, parts == 1):
            if len(out) == 5:
                before, i, wanted, w1, w2 = out
                each, place = at_places(i, wanted)
                yield batch(i[each], place - before, place - before + min_words, w1=w1[each], w2=w2[each], wanted=wanted[each])
            else:
                i, left, right, j = out
                yield spans(i, left, right, j, left)

    order = ["key", "right", "left", "row"]
    if parts > 1:
        found = found.repartitionByRange(parts, *order)
    else:
        found = found.coalesce(1)
    return found.sortWithinPartitions(*order).mapInArrow(tidy(run), MATCH_DDL)


def across(windows: DataFrame) -> DataFrame:
    """Matches of wanted windows with equal ones of other documents."""
    place = F.struct("row", "doc_id", "start")
    groups = windows.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("wanted").alias("any")).where("any and a.row <> b.row").select("w1", "w2", "a", "b")
    other = F.when(F.col("row") == F.col("a.row"), F.col("b")).otherwise(F.col("a"))
    met = windows.where("wanted").join(merge(groups), ["w1", "w2"])
    return met.select("row", "doc_id", "start", "end", other["row"].alias("other_row"), other["doc_id"].alias("other_id"), other["start"].alias("other_start"))


def merged(batches):
    """Spans of each document joined where they overlap; the partner is that of the longest part."""
    schema = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64()), ("other_id", pa.int64()), ("other_start", pa.int64())])
    for batch in batches:
        out = []
        for doc_id, spans in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            now = None
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["other_row"], s["other_start"])):
                if now is None or s["start"] > now[1]:
                    if now:
                        out.append((doc_id, now[0], now[1], now[1] - now[0], *now[3]))
                    now = [s["start"], s["end"], s["end"] - s["start"], (s["other_id"], s["other_start"])]
                else:
                    now[1] = max(now[1], s["end"])
                    if s["end"] - s["start"] > now[2]:
                        now[2:] = [s["end"] - s["start"], (s["other_id"], s["other_start"])]
            if now:
                out.append((doc_id, now[0], now[1], now[1] - now[0], *now[3]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, window: int = WINDOW, neighbours: int = NEIGHBOURS, within: bool = False) -> DataFrame:
    """A row for each repeat: doc_id, start_word, end_word, n_words, and other_id, other_start of a document that shares it."""
    docs, key = with_row_key(docs.select("doc_id", "text"))
    docs = docs.select(F.col(key).alias("row"), "doc_id", "text")
    scanned = materialize(scan(docs, k, window, min_words, within).where(F.col("n") >= min_words), "scanned")
    first = F.min(F.struct("row", "doc_id"))
    copies = scanned.groupBy("f1", "f2").agg(first.alias("a"), F.max(F.struct("row", "doc_id")).alias("b"), F.count("*").alias("c"))
    same = materialize(copies.where("c > 1").select("f1", "f2", "a", "b"), "copies")
    # every copy repeats the first one, and the first one the last
    whole = scanned.select("row", "doc_id", "n", "f1", "f2").join(merge(same), ["f1", "f2"])
    later = whole.where(F.col("row") != F.col("a.row")).select("row")
    other = F.when(F.col("row") == F.col("a.row"), F.col("b")).otherwise(F.col("a"))
    spans = [whole.select("row", "doc_id", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), other["row"].alias("other_row"), other["doc_id"].alias("other_id"), F.lit(0).alias("other_start"))]
    if within:
        inner = scanned.select("row", "doc_id", F.explode("inner").alias("i"))
        spans.append(inner.select("row", "doc_id", "i.start", "i.end", F.col("row").alias("other_row"), F.col("doc_id").alias("other_id"), "i.other_start"))
    single = scanned.join(merge(later), "row", "left_anti")
    anchors = single.select("row", F.explode("keys").alias("key"))
    # a document has each of its keys once
    often = anchors.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    wanted = anchors.join(merge(often), "key").groupBy("row").agg(F.collect_list("key").alias("keys"))
    todo = materialize(suffixes(docs, materialize(wanted, "wanted"), k, window, min_words), "suffixes")
    n = todo.count()
    if n:
        parts = max(1, round(n / RANGE_ROWS))
        done = materialize(sort_and_compare(todo, parts, k, min_words, neighbours), "matches")
        spans.append(done.where("w1 is null").select(*FOUND))
        if parts > 1:
            spans.append(across(done.where("w1 is not null")))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    per = every.groupBy("row", "doc_id").agg(F.collect_list(F.struct("start", "end", "other_row", "other_id", "other_start")).alias("spans"))
    return materialize(per.select("doc_id", "spans").mapInArrow(merged, "doc_id long, start_word long, end_word long, n_words long, other_id long, other_start long"), "repeats")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
