"""Texts as sets of word shingles, each shingle a 64-bit number."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Odd multipliers and the two of a well-known 64-bit finalizer.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: A word's number is a polynomial of its letters' numbers; the letters of 2**17 bytes are taken at a time.
_BASE = 0xD1342543DE82EF95
_SLICE = 1 << 17
_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: A number for each byte of a word; 0 for all that separates words.
_LETTER = np.where(np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789")), mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0]), np.uint64(0))


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of _BASE and of its inverse, at least ``length`` of them."""
    if length > len(_POWERS[0]):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(2 * _SLICE, length), np.uint64(base))
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of every word of a text given as bytes, which ends with no letter."""
    part = _LETTER[raw]
    starts, numbers, at = [], [], 0
    while at < len(raw):
        # A slice ends behind a byte that is no letter, and bounds the memory.
        end = min(at + _SLICE, len(raw))
        while part[end - 1]:
            gaps = np.flatnonzero(part[end : end + _SLICE] == 0)
            end += int(gaps[0]) + 1 if len(gaps) else _SLICE
        own = part[at:end]
        edges = np.flatnonzero(np.diff((own != 0).view(np.int8), prepend=0))
        first, last = edges[::2], edges[1::2]
        power, inverse = _powers(end - at)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[: end - at], dtype=np.uint64)])
        numbers.append(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        at = end
    return np.concatenate(starts), np.concatenate(numbers)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A number for each ``n`` neighbours in ``h``."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        out = mix(out * _ODD[i % len(_ODD)] + h[i : len(h) - n + 1 + i])
    return out


def _sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    raw = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    bounds = np.cumsum([0, *(len(t) + 1 for t in raw)])
    starts, h = _words(np.frombuffer(b"\n".join([*raw, b""]), np.uint8))
    at = np.searchsorted(starts, bounds)  # the first word of each text
    words = np.diff(at)
    text = np.repeat(np.arange(len(texts)), words)
    inside = np.flatnonzero(np.arange(len(h)) + size <= at[1:][text])
    text, runs = text[inside], (_runs(h, size)[inside] if len(inside) else np.empty(0, np.uint64)).view(np.int64)
    order = np.lexsort((runs, text))
    text, runs = text[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (text[1:] != text[:-1]) | (runs[1:] != runs[:-1])
    out = np.split(runs[new], np.searchsorted(text[new], np.arange(1, len(texts))))
    for i in np.flatnonzero((words > 0) & (words < size)):
        out[i] = _runs(h[at[i] : at[i + 1]], words[i]).view(np.int64)
    return out


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The shingle set of each text (empty for null), some texts at a time."""
    out: list[np.ndarray] = []
    some: list[str | None] = []
    held = 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held > _SLICE:
            out += _sets(some, size)
            some, held = [], 0
    return out + (_sets(some, size) if some else [])


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted hashes of all runs of ``size`` neighbouring words (of all words, if fewer; none without words)."""
    return _sets([text], size)[0]


def shingles(size: int):  # noqa: ANN201
    """A column function: the shingle set of a text as a sorted array (empty for null)."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(shingle_sets(texts.tolist(), size), index=texts.index, dtype=object)

    return of


def flat(sets: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The members of all sets one after another, and the sets' sizes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([np.empty(0, np.int64), *sets]), sizes


def parities(grams: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """A row of ``bits`` bits (64 a number) for each set: whether it has an odd number of the shingles of that bit.

    Sets differ in at least as many shingles as bits.
    """
    odd = np.zeros(len(sizes) * bits, np.uint8)
    own = np.repeat(np.arange(len(sizes)), sizes)
    np.bitwise_xor.at(odd, own * bits + (mix(grams.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % bits, 1)
    return np.packbits(odd.reshape(len(sizes), bits), axis=1).view(np.int64)


def most_apart(total: Column, threshold: float) -> Column:
    """In how many shingles two sets may differ that have ``total`` together and reach the threshold."""
    return total - 2 * F.ceil(threshold / (1 + threshold) * total - 1e-9)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets given as arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def distinct_sets(df: DataFrame, grams: str) -> DataFrame:
    """One row per different non-empty set: set_id and the set."""
    return df.where(F.size(grams) > 0).groupBy(set_id(F.col(grams)).alias("set_id")).agg(F.any_value(grams).alias(grams))


def set_id(grams: Column) -> Column:
    """A number that tells a set; equal sets have equal numbers, and different ones differ but for a chance of 2**-64."""
    return F.xxhash64(grams)
