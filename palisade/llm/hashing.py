"""Vectorised 64-bit hashing of words, n-grams and windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of the words (runs of non-white-space) of ``text``, made on the JVM; null for a null text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column of longs; a null list has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(U), lengths


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run of the given lengths starts."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``range(start, start + length)``."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(starts_of(lengths), lengths) + np.repeat(starts, lengths) if total else np.zeros(0, np.int64)


def ngrams(words: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams and the row of each. A row of fewer than n words, but at least one, has one gram: all its words."""
    starts = starts_of(lengths)
    full = np.maximum(lengths - n + 1, 0)
    at = ranges(starts, full)
    grams = np.zeros(len(at), U)
    salts = mix(np.arange(1, n + 1, dtype=U))
    for j in range(n):
        grams += mix(words[at + j] ^ salts[j])
    rows = np.repeat(np.arange(len(lengths)), full)
    short = np.nonzero((lengths > 0) & (lengths < n))[0]
    if len(short):
        sums = np.zeros(len(short), U)
        for j in range(n - 1):
            has = lengths[short] > j
            sums[has] += mix(words[starts[short[has]] + j] ^ salts[j])
        grams, rows = np.concatenate([grams, sums + lengths[short].astype(U)]), np.concatenate([rows, short])
    return mix(grams), rows


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of the windows of ``length`` words at each position of one flat run of words.

    Products of an odd base wrap modulo 2**64, where it has an inverse, so a window is a difference of prefix sums.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        powers = np.ones(len(words), U)
        powers[1:] = U(base)
        np.multiply.accumulate(powers, out=powers)
        back = np.ones(n, U)
        back[1:] = U(inverse)
        np.multiply.accumulate(back, out=back)
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * powers, out=sums[1:])
        return mix((sums[length:] - sums[:n]) * back)
