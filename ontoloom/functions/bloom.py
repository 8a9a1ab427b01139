"""Bloom filter over string keys: built by a JVM-side aggregation, probed in Arrow batches.

The filter's size is the only thing broadcast and has a fixed bound (`max_bits`); with more keys than the size suits,
only its rate of false positives rises, and these are verified by a join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
HASHES = 6


def size(n: int, max_bits: int) -> int:
    want = max(1 << 12, n * BITS_PER_KEY)
    return min(max_bits, 1 << (want - 1).bit_length())


def position(h: np.ndarray, i: int, m: int) -> np.ndarray:
    """The bit of each 64-bit hash h that is looked up at the i-th of HASHES times in a filter of m bits, a power of two."""
    a, b = h * np.uint64(0xFF51AFD7ED558CCD), h * np.uint64(0xC4CEB9FE1A85EC53)
    return (((a ^ (a >> np.uint64(32))) + (b >> np.uint64(32) | np.uint64(1)) * np.uint64(i)) & np.uint64(m - 1)).astype(np.int64)


def among(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter lets through; one that a bit rules out isn't looked up again."""
    left = np.arange(len(h))
    for i in range(HASHES):
        p = position(h[left], i, len(words) * 64)
        left = left[(words[p >> 6] >> (p & 63)) & 1 == 1]
    return left


def _pair(key: Column) -> tuple[Column, Column]:
    """Two hashes below 2^55, so that a + 5 b stays in range."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 9), F.shiftrightunsigned(F.xxhash64(F.lit(2), key), 9)


def build(keys: DataFrame, key: str, max_bits: int = 1 << 26) -> np.ndarray:
    """Words of the filter of keys[key].  At most max_bits / 64 (word, bits) rows reach the driver; nulls are left out."""
    a, b = _pair(F.col(key))
    k = keys.where(F.col(key).isNotNull()).select(a.alias("a"), b.alias("b"))
    m = size(keys.select(F.approx_count_distinct(key)).first()[0], max_bits)
    bits = F.explode(F.array(*[F.pmod(F.col("a") + F.col("b") * i, F.lit(m)) for i in range(HASHES)]))
    words = k.select(bits.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    got = words.toPandas()
    out = np.zeros(m // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return out


def might_contain(df: DataFrame, words: np.ndarray, key: Column) -> Column:
    """Boolean column: false proves that key is not among the filter's keys."""
    shared, m = df.sparkSession.sparkContext.broadcast(words), len(words) * 64

    @F.pandas_udf("boolean")
    def probe(a: pd.Series, b: pd.Series) -> pd.Series:
        w, x, y = shared.value, a.to_numpy(np.int64), b.to_numpy(np.int64)
        ok = np.ones(len(x), bool)
        for i in range(HASHES):
            p = (x + y * i) % m
            ok &= ((w[p >> 6] >> (p & 63)) & 1).astype(bool)
        return pd.Series(ok)

    return probe(*_pair(key))
