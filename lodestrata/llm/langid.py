"""Language identification by multilingual mixture inference.

A text is cut into segments of segment_bytes. Each language gives a segment a likelihood by its byte trigrams;
expectation-maximisation estimates the proportions of the languages in the document. The set of languages is the one of highest
likelihood less penalty * log(segments) for every language after the first: from the mixture of all, the language of the smallest
share is left out and the others are estimated again, down to one, and every set on the way competes, as does the single language
of the highest likelihood. A document may so have any number of languages. The language with the largest share is predicted, its
share is the score.

Fitting uses a sample of at most about per_language labelled documents of each language, drawn by a hash of the id at a
rate that the counts of the languages fix; prediction reads whole texts and nothing but the text.

Defined cases: `und` with score 0 where the text is null or has no letter, or where no language was learned; equal
proportions go to the language that sorts first; repeated rows each get their own result; further columns are ignored. A text is
read whole, in memory of about forty times its bytes; batches hold about 2 MB of other texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import crc_mod, materialize, table, text_slices, tidy

BUCKET_BITS = 16
PER_LANGUAGE, SEGMENT_BYTES, PENALTY, TEMPER, ROUNDS = 3000, 48, 1.0, 0.5, 8
FIT_PARTITIONS = 8

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each byte of a run of texts, and whether that byte is of a letter; a text ends in spaces."""
    b = _FOLD[raw].astype(np.uint32)
    if len(b) > 1:  # U+00C0..U+00DE are the capitals of U+00E0..U+00FE
        upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        b[1:][upper] += 0x20
    before, behind = np.full(len(b), 32, np.uint32), np.full(len(b), 32, np.uint32)
    before[1:], behind[:-1] = b[:-1], b[1:]
    full = np.flatnonzero(np.diff(offsets))
    before[offsets[full]], behind[offsets[full + 1] - 1] = 32, 32
    key = (before << np.uint32(16)) | (b << np.uint32(8)) | behind
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS), b != 32


class Model:
    """Languages in order and log P(trigram | language), one row for each bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray, alpha: float = 0.5):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.log_p = np.ascontiguousarray(np.log((counts + alpha) / (total + alpha * counts.shape[1])).astype(np.float32))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from docs with text and lang; at most about per_language documents of each language are read."""
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 1 << BUCKET_BITS)))
    rate = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < rate[F.col("lang")] * 1e6)

    def count(batches):
        held = np.zeros((len(languages), 1 << BUCKET_BITS))
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi, raw, offsets in text_slices(batch.column("text")):
                bucket, letter = grams(raw, offsets)
                which = np.repeat(lang[lo:hi], np.diff(offsets))
                held += np.bincount((which[letter] << BUCKET_BITS) + bucket[letter], minlength=held.size).reshape(held.shape)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes() for x in held], pa.binary()), pa.array(range(len(languages)), pa.int32())], ["counts", "k"])

    total = np.zeros((len(languages), 1 << BUCKET_BITS))
    for r in materialize(chosen.repartition(FIT_PARTITIONS).mapInArrow(tidy(count), "counts binary, k int"), "grams").toLocalIterator():
        total[r["k"]] += np.frombuffer(r["counts"], "<f8")
    return Model(languages, total)


def sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of x[bounds[i]:bounds[i+1]] along the first axis; empty stretches give 0."""
    out = np.zeros((len(bounds) - 1, *x.shape[1:]), x.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(x, bounds[full], axis=0)
    return out


def mixture(lik: np.ndarray, weight: np.ndarray, bounds: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents of a run at once. lik: segments x languages. Returns shares and log-likelihoods by document."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total = np.maximum(sums(weight, bounds), 1e-9)[:, None]
    for _ in range(rounds):
        r = lik * share[doc]
        r *= (weight / np.maximum(r.sum(axis=1), 1e-300))[:, None]
        share = sums(r, bounds) / total
    return share, sums(np.log(np.maximum((lik * share[doc]).sum(axis=1), 1e-300)), bounds)


def infer(model: Model, raw: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT_BYTES, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Language shares of each text of a run: zero outside the chosen set, all zero without a letter."""
    n, k = len(offsets) - 1, len(model.languages)
    if not k or not len(raw):
        return np.zeros((n, k))
    bucket, letter = grams(raw, offsets)
    lens = np.diff(offsets)
    per = -(-lens // segment)
    bounds = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(offsets[:-1], per) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], per)) * segment
    weight = np.add.reduceat(letter.astype(np.float64), first)
    score = np.stack([np.add.reduceat(np.where(letter, row[bucket], 0).astype(np.float64), first) for row in model.log_p], axis=1) * TEMPER
    top = score.max(axis=1, keepdims=True)
    lik = np.exp(score - top)
    share, _ = mixture(lik, weight, bounds, np.full((n, k), 1 / k), rounds)
    cost = penalty * np.log(np.maximum(per, 2))
    single = sums(score - top, bounds)
    best, rows = np.argmax(single, axis=1), np.arange(n)
    value = single[rows, best]
    out = np.zeros((n, k))
    out[rows, best] = 1
    inside = np.ones((n, k), bool)
    for size in range(k, 1, -1):
        start = np.where(inside, share + 1e-6, 0)
        share, likelihood = mixture(lik, weight, bounds, start / start.sum(axis=1, keepdims=True), max(2, rounds // 2))
        likelihood -= cost * (size - 1)
        better = likelihood > value
        value[better], out[better] = likelihood[better], share[better]
        # the smallest share goes, of equal ones the language that sorts last
        gone = k - 1 - np.argmin(np.where(inside, share, np.inf)[:, ::-1], axis=1)
        inside[rows, gone] = False
    out[sums(letter.astype(np.int64), offsets) == 0] = 0
    return out


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])


def letters(raw: np.ndarray) -> bool:
    """Whether there is an ASCII letter."""
    low = raw | 32
    return bool(((low >= 97) & (low <= 122)).any())


def has_letter(raw: np.ndarray) -> bool:
    return any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the chosen languages with their shares, by falling share."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = held.value
        for batch in batches:
            pred, score, languages, shares = [], [], [], []
            for lo, hi, raw, offsets in text_slices(batch.column("text")):
                found = infer(m, raw, offsets)
                ascii_letter = sums(((raw | 32) >= 97).astype(np.int64) * ((raw | 32) <= 122), offsets) if len(raw) else np.zeros(hi - lo, np.int64)
                for i, row in enumerate(found):
                    order = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
                    known = bool(order) and (ascii_letter[i] > 0 or has_letter(raw[offsets[i] : offsets[i + 1]]))
                    pred.append(m.languages[order[0]] if known else "und")
                    score.append(min(1.0, float(row[order[0]])) if known else 0.0)
                    languages.append([m.languages[k] for k in order] if known else [])
                    shares.append([float(row[k]) for k in order] if known else [])
            cols = [batch.column("doc_id"), batch.column("held_out"), pred, score, languages, shares]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT)

    rows = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return materialize(rows.mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"), "languages")


def keep_identified(docs: DataFrame, model: Model, least: float = 1 / 3) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a share of at least `least`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep: list[bool] = []
            for _, _, raw, offsets in text_slices(batch.column(at)):
                share = infer(held.value, raw, offsets).max(axis=1, initial=0) if held.value.languages else np.zeros(len(offsets) - 1)
                keep += [bool(s >= least and (letters(raw[a:b]) or has_letter(raw[a:b]))) for s, a, b in zip(share, offsets[:-1], offsets[1:], strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # by place, since names may hold dots
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(crc_mod("doc_id", 4) != 2)))
