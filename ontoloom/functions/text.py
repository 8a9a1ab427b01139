"""String expressions whose results don't depend on the regex engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import bloom

SPACE = r"[\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
HAN = "[一-龥]"


def trim(c: Column | str) -> Column:
    """c without any Unicode white space around it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def captures(c: Column | str, pattern: str, *groups: int) -> Column:
    """Array of structs g1, g2, ... with the groups of every match of pattern in c."""
    c = F.col(c) if isinstance(c, str) else c
    got = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in groups]
    return F.transform(F.arrays_zip(*[x.alias(f"g{i}") for i, x in enumerate(got, 1)]), lambda x: F.struct(*[x[f"g{i}"].alias(f"g{i}") for i in range(1, len(groups) + 1)])) if len(groups) > 1 else F.transform(got[0], lambda x: F.struct(x.alias("g1")))


def ngrams(c: Column | str, n: int) -> Column:
    """All runs of n characters, repeated ones too; empty for shorter strings."""
    c = F.col(c) if isinstance(c, str) else c
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


#: Characters of texts whose substrings are hashed at once, and the odd base of their hash.
CHUNK, BASE = 1 << 18, 0x9E3779B97F4A7C15


def _chunks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, code points, lengths) of runs of whole texts of about CHUNK characters."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK):
            n += len(texts[end])
            end += 1
        part = texts[at:end]
        yield at, np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.array([len(t) for t in part], np.int64)
        at = end


def _rolling(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of code * BASE^i modulo 2^64 and the inverse powers: the hash of codes[i:i + n] is (sums[i + n] - sums[i]) * inverse[i]."""
    powers = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(codes), b, np.uint64))])
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) * powers(BASE)[:-1], out=sums[1:])
    return sums, powers(pow(BASE, -1, 1 << 64))


def _key_filter(names: DataFrame, bits: int) -> np.ndarray:
    """Words of a Bloom filter of `bits` bits over the rolling hashes of names' k; at most bits / 64 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, codes, n in _chunks(b.column(0).to_pylist()):
                sums, inverse = _rolling(codes)
                end = np.cumsum(n)
                h = (sums[end] - sums[end - n]) * inverse[end - n]
                p = np.sort(np.concatenate([bloom.position(h, i, bits) for i in range(bloom.HASHES)]))
                w, first = np.unique(p >> 6, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.bitwise_or.reduceat(np.int64(1) << (p & 63), first))], names=["w", "v"])

    got = names.where("k != ''").select("k").mapInArrow(run, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[got["w"].to_numpy()] = got["v"].to_numpy()
    return words


def substrings(rows: DataFrame, column: str, names: DataFrame, max_bits: int = 1 << 26) -> DataFrame:
    """rows with `k`, their distinct lower-cased substrings of column that may be a name's k; containment of names is then an equality join, which drops the rest.

    A substring of a length that no name has, or that a Bloom filter of the names rules out, makes no row, so the rows
    are about as many as the names contained and not as all substrings.  The filter has at most max_bits bits, whatever
    the number of names, and is all that is broadcast; more names only let more substrings pass to the join."""
    count = {r.n: r.c for r in names.select(F.length("k").alias("n")).where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    lengths = sorted(count)
    bits = bloom.size(sum(count.values()), max_bits)
    shared = rows.sparkSession.sparkContext.broadcast(_key_filter(names, bits))
    texts = rows.where(F.col(column).isNotNull()).withColumn("k", F.lower(F.col(column)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for first, codes, size in _chunks(texts):
                sums, inverse = _rolling(codes)
                start = np.cumsum(size) - size
                row = np.repeat(np.arange(len(size)), size)
                room = np.repeat(start + size, size) - np.arange(len(codes))
                at, hits = np.arange(len(codes)), set()
                for n in lengths:
                    at = at[room[at] >= n]
                    if not len(at):
                        break
                    ok = at[bloom.among((sums[at + n] - sums[at]) * inverse[at], words)]
                    hits.update((first + r, texts[first + r][i : i + n]) for r, i in zip(row[ok].tolist(), (ok - start[row[ok]]).tolist()))
                if hits:
                    r, k = zip(*sorted(hits))
                    idx = pa.array(r, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(idx) for i in range(b.num_columns - 1)), pa.array(k, pa.string())], names=b.schema.names)

    return texts.mapInArrow(run, texts.schema)


def answer_tokens(c: Column | str) -> Column:
    """Distinct tokens of an answer: lower-case Latin words of two or more characters, and bigrams over its ideographs taken together."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    latin = F.filter(F.regexp_extract_all(c, F.lit("([a-z0-9_]+)"), F.lit(1)), lambda x: F.length(x) >= 2)
    han = F.regexp_replace(c, "[^一-鿿]", "")
    return F.array_distinct(F.concat(latin, ngrams(han, 2)))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of matrix columns at a time."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        m = row & where.get(ch, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); 1 for two empty strings."""
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0
