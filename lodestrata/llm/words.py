"""Words and word shingles of whole batches of texts, vectorised over the bytes of the Arrow buffer.

A word class is a table of 256 bytes: 0 for a delimiter, else the byte that stands for it (so ASCII case can be
folded on the way). UTF-8 continuation bytes are never ASCII, so classes that hold every byte from 0x80 up agree
with the same class over code points.
"""

from __future__ import annotations

import numpy as np

_P1, _P2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def byte_class(delimiters: str | bytes) -> np.ndarray:
    """The table of a class: every byte but the delimiters, A-Z folded to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(delimiters.encode("latin-1") if isinstance(delimiters, str) else delimiters)] = 0
    return t


#: Words of the set operators: all but ASCII white space (NUL is a word byte there: find_words(..., nul_is_word=True)).
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of the phrase operator: ASCII letters and digits, and whatever is not ASCII.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = x ^ (x >> _S33)
    x *= _P1
    x ^= x >> _S33
    x *= _P2
    x ^= x >> _S33
    return x


def find_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, nul_is_word: bool = False):
    """Words of the texts raw[offsets[i]:offsets[i+1]].

    Returns (folded bytes padded by 8, starts, lengths, bounds): words bounds[i]:bounds[i+1] belong to text i.
    """
    n = len(raw)
    b = np.zeros(n + 16, np.uint8)
    b[:n] = table[raw]
    word = b[: n + 1] != 0
    if nul_is_word:
        word[:n] |= raw == 0
    first = word[:n].copy()
    first[1:] &= ~word[: n - 1] if n else first[1:]
    last = word[:n] & ~word[1 : n + 1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return b, starts, lengths, np.searchsorted(starts, offsets)


def word_hashes(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    at = np.ndarray((len(b) - 7,), "<u8", b, 0, (1,))
    h = mix(lengths.astype(np.uint64) * _STEP)
    h = mix(h ^ (at[starts] & _MASKS[np.minimum(lengths, 8)]))
    live = np.flatnonzero(lengths > 8)
    k = 8
    while len(live):
        rest = np.minimum(lengths[live] - k, 8)
        h[live] = mix(h[live] * _STEP ^ (at[starts[live] + k] & _MASKS[rest]))
        k += 8
        live = live[lengths[live] > k]
        if len(live) and k >= 256:  # a few very long words: the rest of each in one go
            for i in live:
                tail = b[starts[i] + k : starts[i] + lengths[i]]
                padded = np.zeros(-(-len(tail) // 8) * 8, np.uint8)
                padded[: len(tail)] = tail
                w = mix(padded.view("<u8") ^ (np.arange(len(padded) // 8, dtype=np.uint64) * _STEP))
                h[i] = mix(h[i : i + 1] * _STEP ^ w.sum(dtype=np.uint64))[0]
            break
    return h


def shingles(h: np.ndarray, bounds: np.ndarray, k: int):
    """Hashes of k consecutive words, and bounds by text; a text of fewer words (but not none) has one, of all of them."""
    n = len(h)
    counts = np.diff(bounds)
    rows = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(rows)])
    out = np.zeros(out_bounds[-1], np.uint64)
    if n >= k:
        acc = h[: n - k + 1].copy()
        for j in range(1, k):
            acc *= _STEP
            acc += h[j : n - k + 1 + j]
        acc = mix(acc)
        full = np.flatnonzero(counts >= k)
        if len(full):
            lens = rows[full]
            shift = np.repeat(bounds[full] - out_bounds[full], lens)
            place = _ranges(out_bounds[full], lens)
            out[place] = acc[place + shift]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        a = np.uint64(counts[i])
        for x in h[bounds[i] : bounds[i + 1]]:
            a = np.uint64((int(a) * int(_STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[out_bounds[i]] = mix(np.array([a]))[0]
    return out, out_bounds


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers of start..start+len of each range, one after the other."""
    total = int(lens.sum())
    return np.arange(total) + np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)


ranges = _ranges
