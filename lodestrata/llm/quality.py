"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are computed for a batch of texts at a time from its bytes. Trees are grown level by level on
at most BINS quantile bins of each statistic, by the gradients and Hessians of the logistic loss, and flattened into arrays
(feature, threshold, left child, value) that numpy walks for all documents of a batch at once.

Fitting reads about FIT_ROWS labelled documents (2 * FIT_ROWS rows at most), drawn by a hash of the id at a rate that their
count fixes, which is also the bound of the broadcast of their ids; scoring
reads every whole text and nothing but the text.

Defined cases: a null text is empty and gets a score like any other; without labels, or with labels of one kind only, every
score is their mean (0.5 without any); null labels are left out, and several labels of a document count as their mean;
repeated documents each get their own result; further columns are ignored. A text is read whole, in memory of about forty times
its bytes; batches hold about 2 MB of other texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import crc_mod, materialize, table, text_slices, tidy
from lodestrata.llm.langid import sums
from lodestrata.llm.words import SPACED, find_words, shingles, word_hashes

FIT_ROWS, BINS = 30_000, 64
TREES, DEPTH, RATE, RIDGE, MIN_ROWS = 120, 4, 0.1, 5.0, 20
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "space": [32], "newline": [10], "stop": b".", "comma": b",", "mark": b"!?",
    "pipe": b"|", "symbol": b"#$%&*+=<>@^~", "bracket": b"()[]{}", "quote": b"\"'", "slash": b"/\\_:;-",
}
_CODE = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_CLASSES.values(), 1):
    _CODE[list(_bytes)] = _k
NAMES = [
    "log_bytes", "log_words", *(f"share_{k}" for k in _CLASSES), "share_other", "word_mean", "word_std", "word_max", "short_words", "long_words", "capital_words", "marked_words",
    "log_lines", "line_mean", "empty_lines", "distinct_words", "top_word", "distinct_pairs", "repeated_pairs", "next_same", "distinct_lines", "byte_entropy", "runs",
]


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: the number of different values, the count of the commonest, and the occurrences of values that repeat."""
    n = len(bounds) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))
    at = np.flatnonzero(new)
    count, owner = np.diff(np.append(at, len(hs))), ds[at]
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=n).astype(float), top, np.bincount(owner, np.where(count > 1, count, 0), minlength=n)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x NAMES."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    code = _CODE[raw]
    k = len(_CLASSES) + 1
    shares = np.bincount(doc * k + code, minlength=n * k).reshape(n, k) / some[:, None]
    b, starts, lengths, bounds = find_words(raw, offsets, SPACED, nul_is_word=True)
    words = np.diff(bounds).astype(float)
    w = np.maximum(words, 1)
    h = word_hashes(b, starts, lengths)
    first, last = raw[starts], raw[starts + lengths - 1]
    of = lambda x: sums(x.astype(float), bounds)
    mean = of(lengths) / w
    std = np.sqrt(np.maximum(of(lengths.astype(float) ** 2) / w - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), np.diff(bounds)), lengths)
    different, top, _ = distinct(h, bounds)
    pairs, pair_bounds = shingles(h, bounds, 2)
    n_pairs = np.maximum(np.diff(pair_bounds), 1)
    pair_different, _, pair_repeats = distinct(pairs, pair_bounds)
    word_doc = np.repeat(np.arange(n), np.diff(bounds))
    same = np.bincount(word_doc[1:][(h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])], minlength=n) if len(h) else np.zeros(n)
    lines_table = np.arange(256, dtype=np.uint8)
    lines_table[10] = 0
    lb, ls, ll, lbounds = find_words(raw, offsets, lines_table)
    lines = np.diff(lbounds).astype(float)
    line_different, _, _ = distinct(word_hashes(lb, ls, ll), lbounds)
    newlines = shares[:, list(_CLASSES).index("newline") + 1] * some
    histogram = np.bincount(doc * 256 + raw, minlength=n * 256).reshape(n, 256) / some[:, None]
    entropy = -(histogram * np.log2(np.maximum(histogram, 1e-12))).sum(axis=1)
    runs = np.bincount(doc[1:][(raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(raw) else np.zeros(n)
    marks = np.isin(_CODE[last], [list(_CLASSES).index(c) + 1 for c in ("mark", "symbol", "pipe")])
    cols = [
        np.log1p(size), np.log1p(words), *shares[:, 1:].T, shares[:, 0], mean, std, np.log1p(longest), of(lengths <= 3) / w, of(lengths > 12) / w, of((first >= 65) & (first <= 90)) / w, of(marks) / w,
        np.log1p(lines), size / np.maximum(lines, 1), np.maximum(newlines - lines, 0) / np.maximum(newlines, 1), different / w, top / w, pair_different / n_pairs, pair_repeats / n_pairs, same / w,
        line_different / np.maximum(lines, 1), entropy, runs / some,
    ]
    return np.stack(cols, axis=1)


@dataclass
class Forest:
    """Trees as arrays: node i of a tree goes to left[i] if x[feature[i]] <= threshold[i], else to left[i] + 1; a leaf has left 0."""

    base: float
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for r in self.root:
            at = np.full(len(x), r)
            while (inner := self.left[at] > 0).any():
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit by boosting on histograms."""
    n, f = x.shape
    mean = float(y.mean()) if n else 0.5
    base = float(np.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6))))
    feature, threshold, left, value, root = [0], [0.0], [0], [0.0], []
    if n and y.min() < y.max():
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(f) * BINS
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, hess = p - y, p * (1 - p)
            node = np.full(n, len(feature))
            root.append(len(feature))
            feature.append(0), threshold.append(0.0), left.append(0), value.append(0.0)
            open_nodes = [len(feature) - 1]
            for level in range(depth + 1):
                following = []
                for t in open_nodes:
                    rows = np.flatnonzero(node == t)
                    G, H = g[rows].sum(), hess[rows].sum()
                    value[t] = float(-RATE * G / (H + RIDGE))
                    if level == depth or len(rows) < 2 * MIN_ROWS:
                        continue
                    spots = flat[rows].ravel()
                    hg = np.bincount(spots, np.repeat(g[rows], f), f * BINS).reshape(f, BINS).cumsum(axis=1)
                    hh = np.bincount(spots, np.repeat(hess[rows], f), f * BINS).reshape(f, BINS).cumsum(axis=1)
                    hn = np.bincount(spots, minlength=f * BINS).reshape(f, BINS).cumsum(axis=1)
                    gain = hg**2 / (hh + RIDGE) + (G - hg) ** 2 / (H - hh + RIDGE) - G**2 / (H + RIDGE)
                    gain[(hn < MIN_ROWS) | (len(rows) - hn < MIN_ROWS)] = -1
                    j, k = divmod(int(gain.argmax()), BINS)
                    if gain[j, k] <= 1e-6 or k >= len(cuts[j]):
                        continue
                    feature[t], threshold[t], left[t] = j, float(cuts[j][k]), len(feature)
                    for _ in range(2):
                        feature.append(0), threshold.append(0.0), left.append(0), value.append(0.0)
                    node[rows] = left[t] + (binned[rows, j] > k)
                    following += [left[t], left[t] + 1]
                open_nodes = following
            margin += np.array(value)[node]
    return Forest(base, np.array(root, np.int64), np.array(feature), np.array(threshold), np.array(left), np.array(value))


def _stats(batches):
    for batch in batches:
        for lo, hi, raw, offsets in text_slices(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("label")[lo:hi], pa.array(list(statistics(raw, offsets)), pa.list_(pa.float64()))], ["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = FIT_ROWS) -> Forest:
    """Learn labels[target] (0 or 1) from the texts of docs; at most about rows documents are read."""
    known = labels.where(F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.avg(F.col(target).cast("double")).alias("label"))
    rate = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < rate * 1e6)
    found = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(tidy(_stats), "label double, x array<double>"), "statistics")
    x, y = [], []
    for r in found.toLocalIterator():
        if len(x) >= 2 * rows:  # only where an id stands for very many rows
            break
        x.append(r["x"])
        y.append(r["label"])
    order = np.lexsort(np.array(x).T[::-1]) if x else []  # whatever order the rows came in
    return grow(np.array(x).reshape(-1, len(NAMES))[order], np.array(y)[order])


def score_quality(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document row."""
    held = docs.sparkSession.sparkContext.broadcast(forest)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def predict(batches):
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch.column("text")):
                p = held.value.score(statistics(raw, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return materialize(rows.mapInArrow(tidy(predict), "doc_id long, held_out boolean, score double, predicted int"), "scores")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return score_quality(docs, fit(docs, learned))
