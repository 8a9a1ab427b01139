"""Problem 3: duplicates hidden by formatting differences.

Records are collapsed on their canonical bytes.  Partial counts per Arrow stream come first, so a text that makes up a
third of all rows leaves each task as one row.  Recursive radix partitioning then cuts the partial counts by the first
8 bytes; buckets over the limit are cut by 16, 32, ... bytes until each fits, and each bucket's texts are counted in a
trie with terminal counters.

Results: rows whose text is null or holds no token belong to no group; a null frequency counts as 0 in the sum; rows
with equal log_id count as one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm import sql_canon
from ontoloom.session import cut, discard

#: Most texts that one trie holds in memory, at every size of the input.
BUCKET_ROWS = 50_000
#: Most groups that are joined by broadcast: those with over this part of all rows.
MOST_HOT = 4096
FIRST_BYTES = 8
FLUSH = 100_000
STRIDE = 16


class Trie:
    """Byte trie with edges of STRIDE bytes; a node's terminal counters are [copies, sum of frequency, first id]."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, n: int, freq: int, first: int) -> None:
        node = self.root
        for i in range(0, len(key), STRIDE):
            node = node.setdefault(key[i : i + STRIDE], {})
        c = node.get(None)
        if c is None:
            node[None] = [n, freq, first]
        else:
            c[0] += n
            c[1] += freq
            c[2] = min(c[2], first)

    def items(self) -> Iterator[tuple[bytes, list[int]]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for edge, below in node.items():
                if edge is None:
                    yield prefix, below
                else:
                    stack.append((prefix + edge, below))


def canonical_rows(log: DataFrame, text: str = "sql", key: str = "log_id", weight: str = "frequency") -> DataFrame:
    """(key, weight, canon) of the rows that hold a query."""

    @F.pandas_udf("string")
    def canon(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)
        made = [sql_canon.canonical(v) for v in values]
        return pd.Series([made[c] if c >= 0 else None for c in codes], dtype=object)

    return log.select(F.col(key).alias("log_id"), F.coalesce(F.col(weight).cast("bigint"), F.lit(0)).alias("frequency"), canon(F.col(text)).alias("canon")).where("canon is not null")


_COUNTS = "canon binary, n bigint, freq bigint, first bigint"


def _batch(rows: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in range(3))], names=["canon", "n", "freq", "first"])


def partial_counts(rows: DataFrame) -> DataFrame:
    """Counts within each Arrow stream; a table of at most FLUSH texts is kept and emitted when full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for b in batches:
            for k, f, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = seen.get(k)
                if c is None:
                    seen[k] = [1, f, i]
                else:
                    c[0] += 1
                    c[1] += f
                    c[2] = min(c[2], i)
            if len(seen) >= FLUSH:
                yield _batch(list(seen.items()))
                seen = {}
        if seen:
            yield _batch(list(seen.items()))

    return rows.select(F.col("canon").cast("binary").alias("canon"), "frequency", "log_id").mapInArrow(run, _COUNTS)


def radix_buckets(counts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """counts with `bucket`, the shortest of the prefixes of 8, 16, 32, ... bytes that at most bucket_rows rows share.

    Each level's oversized prefixes are a table, joined by whatever way its size allows; only rows under them go on to
    the next level.  A prefix that holds whole texts only cannot be split further and needs none: it is one text, one
    counter."""
    bytes_, open_rows, done = FIRST_BYTES, counts, None
    while True:
        keyed = open_rows.withColumn("bucket", F.substring("canon", 1, bytes_))
        over = cut(keyed.where(F.octet_length("canon") > bytes_).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("bucket"))
        if over.isEmpty():
            discard(over)
            return keyed if done is None else done.unionByName(keyed)
        fits = keyed.join(over, "bucket", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        open_rows = cut(keyed.join(over, "bucket", "left_semi").drop("bucket"))
        bytes_ *= 2


def count_tries(bucketed: DataFrame) -> DataFrame:
    """(canon, n_copies, sum_frequency, first_log_id): one trie per bucket, emitted when the next bucket begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = Trie(), None
        for b in batches:
            for bucket, k, n, f, i in zip(*(b.column(c).to_pylist() for c in range(5))):
                if bucket != now:
                    if now is not None:
                        yield _batch(list(trie.items()))
                    trie, now = Trie(), bucket
                trie.add(k, n, f, i)
        if now is not None:
            yield _batch(list(trie.items()))

    parts = bucketed.select("bucket", "canon", "n", "freq", "first").repartition("bucket").sortWithinPartitions("bucket")
    made = parts.mapInArrow(run, _COUNTS)
    return made.select(F.col("canon").cast("string").alias("canon"), F.col("n").alias("n_copies"), F.col("freq").alias("sum_frequency"), F.col("first").alias("first_log_id"))


def groups(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per query of canonical rows."""
    return count_tries(radix_buckets(cut(partial_counts(rows)), bucket_rows))


def collapse(log: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each query once: first_log_id, canonical_sql, n_copies, sum_frequency."""
    return groups(canonical_rows(log), bucket_rows).select("first_log_id", F.col("canon").alias("canonical_sql"), "n_copies", "sum_frequency")


def found(log: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(first_log_id, log_id) of each copy but the first.  Groups with over a 4096th of all rows, 4096 at most, are joined by broadcast; the rest by shuffle."""
    rows = cut(canonical_rows(log))
    g = cut(groups(rows, bucket_rows).where("n_copies > 1"))
    hot = max(1000, -(-rows.count() // MOST_HOT))
    many = F.broadcast(g.where(F.col("n_copies") > hot).select("canon", F.col("first_log_id").alias("hot_first")))
    marked = rows.select("log_id", "canon").join(many, "canon", "left")
    easy = marked.where("hot_first is not null").select(F.col("hot_first").alias("first_log_id"), "log_id")
    rest = marked.where("hot_first is null").select("log_id", "canon").join(g.where(F.col("n_copies") <= hot).select("canon", "first_log_id"), "canon").select("first_log_id", "log_id")
    return easy.unionByName(rest).where("log_id > first_log_id")
