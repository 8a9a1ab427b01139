"""Problem 8: mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the largest total for which no source must exceed its cap, over its own
size.  Each document's number of copies inverts, at a uniform number hashed from its id, the distribution of a Poisson
variable cut off at the cap, whose parameter is fitted so that the copies drawn reach the tokens wanted.  So the choice of a document depends on nothing but its
id, its source and the rates; copies are exploded and shuffled globally by another hash.

Results: documents without source, with blank source or with a source that has no target take no part; neither do
texts without tokens.  A target without documents keeps share 0 in the report.  Sizes reach the driver per source only,
as many rows as there are targets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.ids import strip
from ontoloom.llm import tokens
from ontoloom.session import cut

SEED = 20240601
BINS = 4096


def norm_source(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), "-", "_")
    return F.when(s != "", s)


def cut_poisson(mu: float, cap: int) -> list[float]:
    """Cumulative distribution of min(Poisson(mu), cap) at 0 .. cap."""
    if math.isinf(mu):
        return [0.0] * cap + [1.0]
    p, total, out = math.exp(-mu), 0.0, []
    for k in range(cap):
        total += p
        out.append(min(1.0, total))
        p *= mu / (k + 1)
    return [*out, 1.0]


def times(cdf: list[float], u: np.ndarray) -> np.ndarray:
    """Copies at the uniform numbers u: the steps of the distribution at or below each."""
    return np.searchsorted(np.asarray(cdf[:-1]), u, side="right")


def fit(goal: float, u: np.ndarray, weight: np.ndarray, cap: int) -> list[float]:
    """Distribution whose copies of the weights at u sum up nearest to goal: mu is found by bisection, as copies only grow with it."""
    got = lambda mu: float((times(cut_poisson(mu, cap), u) * weight).sum())
    if goal >= cap * weight.sum() * (1 - 1e-12):
        return cut_poisson(math.inf, cap)
    lo, hi = 0.0, 1.0
    while got(hi) < goal and hi < 600:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if got(mid) < goal else (lo, mid)
    return cut_poisson(min((lo, hi), key=lambda m: abs(got(m) - goal)), cap)


def sized(docs: DataFrame, path: str = f"{tokens.TOKENIZERS}/{tokens.DEFAULT}") -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with a source, tokenized once."""
    d = docs.select("doc_id", norm_source("source").alias("source"), "text").where("source is not null")
    return cut(tokens.count(d, ["doc_id", "source"], path=path).where("n_tokens > 0"))


def uniform(seed: int) -> Column:
    """Number in [0, 1) hashed from doc_id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))


def plan(sizes: DataFrame, targets: DataFrame, seed: int = SEED) -> list[dict]:
    """One entry per target: tokens of the source, rate, distribution.

    The driver sees a histogram of each target's tokens over BINS intervals of the documents' uniform numbers, so at
    most targets x BINS rows; on it the distribution's parameter is fitted to the tokens wanted."""
    want = [r.asDict() for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").select(norm_source("source").alias("source"), "target_share", "max_repeats").collect()]
    names = F.broadcast(sizes.sparkSession.createDataFrame([(w["source"],) for w in want], "source string"))
    hist = sizes.join(names, "source").groupBy("source", F.floor(uniform(seed) * BINS).alias("bin")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.avg(uniform(seed)).alias("u")).toPandas()
    have = dict(list(hist.groupby("source")))
    for w in want:
        h = have.get(w["source"])
        w["tokens"], w["docs"] = (int(h.tokens.sum()), int(h.docs.sum())) if h is not None else (0, 0)
    total = min((w["max_repeats"] * w["tokens"] / w["target_share"] for w in want if w["tokens"]), default=0.0)
    for w in want:
        h, cap = have.get(w["source"]), w["max_repeats"]
        w["rate"] = min(cap, w["target_share"] * total / w["tokens"]) if w["tokens"] else 0.0
        w["cdf"] = fit(w["rate"] * w["tokens"], h.u.to_numpy(float), h.tokens.to_numpy(float), cap) if w["tokens"] else [1.0] * (cap + 1)
    return want


def copies(sizes: DataFrame, planned: list[dict], seed: int = SEED) -> DataFrame:
    """sizes with n_copies, for the sources of the plan: the steps of the source's distribution at or below the document's number."""
    dist = sizes.sparkSession.createDataFrame([(w["source"], w["cdf"][:-1]) for w in planned], "source string, cdf array<double>")
    return sizes.join(F.broadcast(dist), "source").withColumn("u", uniform(seed)).withColumn("n_copies", F.expr("size(filter(cdf, x -> x <= u))")).drop("u", "cdf")


def mix(sizes: DataFrame, planned: list[dict], seed: int = SEED) -> DataFrame:
    """(shuffle_key, doc_id, copy_no, source, n_tokens) in globally shuffled order."""
    c = copies(sizes, planned, seed).where("n_copies > 0")
    each = c.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    keyed = each.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"))
    return keyed.select("shuffle_key", "doc_id", "copy_no", "source", "n_tokens").orderBy("shuffle_key", "doc_id", "copy_no")


def shares(sizes: DataFrame, planned: list[dict], seed: int = SEED) -> DataFrame:
    """Per target: what it holds, its rate, and the share reached."""
    spark = sizes.sparkSession
    out = copies(sizes, planned, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens_out"), F.sum("n_copies").cast("bigint").alias("docs_out"), F.max("n_copies").cast("int").alias("most_repeats"))
    base = spark.createDataFrame([(w["source"], float(w["target_share"]), int(w["max_repeats"]), w["docs"], w["tokens"], float(w["rate"])) for w in planned], "source string, target_share double, max_repeats int, docs_in bigint, tokens_in bigint, rate double")
    j = F.broadcast(base).join(out, "source", "left").fillna(0, ["tokens_out", "docs_out", "most_repeats"])
    total = F.sum("tokens_out").over(Window.partitionBy(F.lit(0)))  # as many rows as there are targets
    return j.withColumn("actual_share", F.coalesce(F.col("tokens_out") / F.nullif(total, F.lit(0)), F.lit(0.0)))
