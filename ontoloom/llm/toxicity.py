"""Problem 9: abusive, hateful or sexual content.

A text becomes units (ideographs, words) after its disguises are taken off.  Labels alone teach what is telling: grams of
units get log-odds of toxic against all text, toxic rates being smoothed by a Dirichlet prior whose mean is the gram's
rate over all documents, bounded by their log-odds of toxic against harmless labels.  A gram is telling if its count in
toxic texts is beyond chance by itself, or if it is unlikely and most of those texts have other telling grams beside it.
What stands right and left of a telling gram in labelled harmless texts takes its weight away again ("白痴级教程").  A
linear-time scan then finds every maximal-scoring segment, and the best segment of a text is turned into a p-value by an
extreme-value law of harmless labelled texts, so that long texts aren't flagged for their length.

The law and the p-value that decides are taken from scores that leave the text's own label out of every count, so no text
judges itself.  Fitting uses at most MAX_LABELLED labelled documents, chosen by hash; its grams are those of two toxic
ones or more.  Rates of grams come from all documents and every text is scored whole.  Results: null, empty and blank
texts have score 0; a document's label is its raters' majority, ties being left out; without toxic labels nothing is flagged.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.mixing import norm_source
from ontoloom.session import cut, discard

MAX_LABELLED = 20_000
ORDERS = 4
PRIOR_DOCS = 30.0
DRIFT = 0.6
TOP = 3.0
#: Log-odds that a gram must reach against all documents: kinds of text that draw more abuse raise the odds of their harmless phrases a little too.
LEAST = 1.0
#: Log-odds of toxic against harmless labels that a gram must reach over those of all labels, each class having PRIOR_LABELS in proportion.
PURITY, PRIOR_LABELS = 2.5, 2.0
#: Likelihood ratios of a gram's count in toxic texts: HIGH carries it alone (chance among all grams tried), LOW if SHARE of those texts have other telling grams of weight NEAR within REACH units.
HIGH, LOW = 24.0, 8.0
SHARE, NEAR, REACH = 0.8, 2.0, 12
CONFIRM_ROUNDS = 2

#: Digits and signs that stand for letters, and characters of other spelling.
LEET = str.maketrans("013457@$!", "oieastasi")
VARIANTS = str.maketrans("滾亂幹髒婊們媽", "滚乱干脏婊们妈")

_HAN = "㐀-鿿"
_JUNK = re.compile("[­​-‏⁠️﻿]")
_BETWEEN = re.compile(rf"(?<=[{_HAN}])[\s~*·.\-_丨|'`^+/\\]{{1,3}}(?=[{_HAN}])")
_SPELLED = re.compile(r"(?<![a-z0-9])(?:[a-z0-9@$!][.\-_*~·丨| ]){2,}[a-z0-9@$!](?![a-z0-9])")
_LEET_WORD = re.compile(r"[a-z0-9@$!]*[a-z][a-z0-9@$!]*")
_RUN = re.compile(r"([a-z])\1+")
_UNIT = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+|\d+|[。！？!?;；\n]|[.](?=\s)")


def bare(text: str) -> str:
    """text without disguises: full width, zero-width characters, separators between letters, letters spelled as digits, drawn-out letters."""
    t = _JUNK.sub("", unicodedata.normalize("NFKC", text)).lower().translate(VARIANTS)
    t = _BETWEEN.sub("", t)
    t = _SPELLED.sub(lambda m: re.sub(r"[^a-z0-9@$!]", "", m.group()), t)
    t = _LEET_WORD.sub(lambda m: m.group() if m.group().isalpha() else m.group().rstrip("!").translate(LEET) if sum(c.isalpha() for c in m.group()) > 1 else m.group(), t)
    return _RUN.sub(r"\1", t)


_WORD = 1 << 31  # codes of words begin here


@lru_cache(maxsize=200_000)
def code(unit: str) -> int:
    """Number of a unit: 0 for sentence ends, 1 for numbers, the code point of an ideograph, a hash for words."""
    if len(unit) == 1 and not unit.isalnum():
        return 0
    if unit[0].isdigit():
        return 1
    return ord(unit) if len(unit) == 1 else int.from_bytes(blake2b(unit.encode(), digest_size=4).digest(), "big") | _WORD


def units(text: str) -> np.ndarray:
    return np.array([code(u) for u in _UNIT.findall(bare(text))], np.uint32)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(u: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n units from each position on; 0 where they would cross a sentence end or, for n = 1, are an ideograph."""
    m = len(u) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h, ok = np.full(m, n, np.uint64), np.ones(m, bool)
    for k in range(n):
        part = u[k : k + m].astype(np.uint64)
        h = (h ^ part) * _MULT
        h ^= h >> np.uint64(29)
        ok &= part != 0
    if n == 1:
        ok &= u >= _WORD
    return np.where(ok, (h | np.uint64(1)).astype(np.int64), 0)


def all_grams(u: np.ndarray) -> np.ndarray:
    g = np.unique(np.concatenate([grams(u, n) for n in range(1, ORDERS + 1)])) if len(u) else np.zeros(0, np.int64)
    return g[g != 0]


def at(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each h among the keys, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == h, i, -1)


def known(sorted_keys: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Indices of the keys that are grams of u, once each."""
    found = [at(sorted_keys, grams(u, n)) for n in range(1, ORDERS + 1)] if len(u) else []
    i = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return i[i >= 0].astype(np.int64)


class Model:
    """Weights of telling grams, what labelled contexts take away, and the law of the best segment's score.

    Counts are kept beside the weights, so that a labelled text is scored as if its own label were unknown (own)."""

    def __init__(self, n_tox: int, n_ok: int, keys: np.ndarray, tox: np.ndarray, ok: np.ndarray, rate: np.ndarray):
        self.n_tox, self.n_ok = n_tox, n_ok
        self.keys, self.tox, self.ok, self.rate, self.sure = keys, tox, ok, rate, None
        self.ctx_keys, self.ctx_tox, self.ctx_ok = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.scale, self.shift, self.limit = 1.0, 0.0, 0.0
        self.keep()

    def weigh(self, t: np.ndarray, f: np.ndarray, rate: np.ndarray, sure: np.ndarray | None) -> np.ndarray:
        """Weights of grams in t toxic and f harmless labelled texts and the share `rate` of all, of whose toxic texts `sure` have other telling grams near (None: not known yet); 0 for those not telling."""
        q = (self.n_tox + 0.5) / (self.n_tox + self.n_ok + 1)
        smooth = t + PRIOR_DOCS * rate
        odds = np.log(smooth / (self.n_tox + PRIOR_DOCS)) - np.log(rate) - 1 / np.sqrt(smooth)
        pure = np.log((t + PRIOR_LABELS * q) / (f + PRIOR_LABELS * (1 - q))) - math.log(q / (1 - q))
        expect = max(self.n_tox, 0.1) * rate
        surprise = 2 * (t * np.log(np.maximum(t, 1e-9) / expect) - (t - expect))
        good = (t >= 2) & (odds > LEAST) & (pure > PURITY) & (surprise > LOW)
        if sure is not None:
            good &= (surprise > HIGH) | (sure >= np.maximum(2, SHARE * t))
        return np.where(good, np.minimum(np.minimum(odds, pure), TOP), 0.0)

    def keep(self, sure: np.ndarray | None = None) -> None:
        """Weighs the grams and lets go of those that aren't telling."""
        w = self.weigh(self.tox, self.ok, self.rate, sure)
        k = w > 0
        self.keys, self.tox, self.ok, self.rate, self.weights = self.keys[k], self.tox[k], self.ok[k], self.rate[k], w[k]
        self.sure = None if sure is None else sure[k]

    def hits(self, u: np.ndarray, own: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weight and length of the longest telling gram that begins at each position; 0 for none."""
        w, length = np.zeros(len(u)), np.zeros(len(u), np.int64)
        for n in range(1, ORDERS + 1):
            i = at(self.keys, grams(u, n))
            hit = np.flatnonzero(i >= 0)
            if not len(hit):
                continue
            x = self.weights[i[hit]]
            if own is not None:
                k = i[hit]
                x = self.weigh(np.maximum(self.tox[k] - own, 0), np.maximum(self.ok[k] - (not own), 0), self.rate[k], None if self.sure is None else self.sure[k] - own)
            w[hit[x > 0]], length[hit[x > 0]] = x[x > 0], n
        return w, length

    def contexts(self, u: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the windows of four units over each telling gram of hits(), by where they begin."""
        w, length = found
        pos = np.flatnonzero(w > 0)
        if not len(pos) or len(u) < ORDERS:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = grams(u, ORDERS)
        out = []
        for back in range(ORDERS):
            start = pos - back
            inside = (start >= 0) & (start < len(h)) & (back + length[pos] <= ORDERS)
            keep = inside & (h[np.clip(start, 0, len(h) - 1)] != 0)
            out.append((pos[keep], h[start[keep]]))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def positions(self, u: np.ndarray, own: bool | None = None) -> np.ndarray:
        """Score of each position: its telling gram's weight, less what the most harmless context says, or the drift."""
        w, length = self.hits(u, own)
        if len(self.ctx_keys) and (w > 0).any():
            pos, h = self.contexts(u, (w, length))
            i = at(self.ctx_keys, h)
            pos, i = pos[i >= 0], i[i >= 0]
            t, f = self.ctx_tox[i], self.ctx_ok[i]
            if own is not None:
                t, f = np.maximum(t - own, 0), f - (not own)
            says = np.log((t + 1) / (self.n_tox + 1)) - np.log((np.maximum(f, 0) + 0.3) / (self.n_ok + 1)) - 1.5  # one harmless label alone may be a rater's slip
            np.minimum.at(w, pos[f >= 1], says[f >= 1])
        return np.where(w > 0, w, np.where(u == 0, -2 * DRIFT, np.minimum(w, 0) - DRIFT))

    def confirmed(self, u: np.ndarray) -> np.ndarray:
        """Indices of the telling grams of a text that have others of weight NEAR within REACH units, none sharing a unit with them."""
        w, _ = self.hits(u)
        total = np.concatenate(([0.0], np.cumsum(w)))
        out = []
        for n in range(1, ORDERS + 1):
            i = at(self.keys, grams(u, n))
            p = np.flatnonzero(i >= 0)
            lo, hi = np.maximum(p - REACH, 0), np.minimum(p + n + REACH, len(u))
            before = total[np.maximum(lo, p - ORDERS + 1)] - total[lo]
            after = total[hi] - total[np.minimum(hi, p + n)]
            out.append(i[p[before + after >= NEAR]])
        return np.unique(np.concatenate(out))

    def best(self, u: np.ndarray, own: bool | None = None) -> tuple[float, int, list[tuple[int, int, float]]]:
        s = self.positions(u, own)
        if not (s > 0).any():
            return 0.0, len(u), []
        seg = segments(s)
        return max(x[2] for x in seg), len(u), seg

    def p_value(self, score: float, n: int) -> float:
        """Chance that a harmless text of n units has a segment of this score."""
        return -math.expm1(-math.exp(min(50.0, math.log(max(n, 20)) + self.shift - self.scale * score))) if score > 0 else 1.0


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (from, to, score), in one scan with a stack of disjoint candidates.

    Each candidate keeps the place of the last one below it whose sum before is smaller; a search goes along these links,
    as all between have greater sums, so the whole scan takes time linear in the positions."""
    out: list[tuple[int, int, float, float, int]] = []  # from, to, sum before, sum up to the end, link
    total = np.concatenate(([0.0], np.cumsum(s)))
    for k in np.flatnonzero(s > 0).tolist():
        lo, left, right = k, total[k], total[k + 1]
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                break
            lo, left, j, gone = out[j][0], out[j][2], out[j][4], j
            del out[gone:]
        out.append((lo, k + 1, left, right, j))
    return [(a, b, r - l) for a, b, l, r, _ in out]


def majority(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most MAX_LABELLED documents."""
    v = labels.groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("share")).where("share is not null and share != 0.5")
    return v.select("doc_id", (F.col("share") > 0.5).alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)


def _sums(df: DataFrame, columns: list[str], make) -> tuple[np.ndarray, ...]:
    """Per gram, sums over documents of what make(batch) yields as (hashes, *numbers); each stream adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [x for x in make(b) if len(x[0])]
            if parts:
                keys, inv = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
                vals = [np.bincount(inv, np.concatenate([np.broadcast_to(x[1 + c], len(x[0])) for x in parts]), len(keys)) for c in range(len(columns))]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(v) for v in vals)], names=["h", *columns])

    return df.mapInArrow(run, "h bigint, " + ", ".join(f"{c} double" for c in columns)).groupBy("h").agg(*[F.sum(c).alias(c) for c in columns])


def unit_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, k, u): the units of each text, cut once for all passes, as little-endian 32-bit numbers; null texts have none.  k is alike for texts that differ in numbers, blanks and punctuation only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [units(x or "").astype("<u4").tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(u, pa.binary())], names=["doc_id", "source", "k", "u"])

    same = F.xxhash64(F.regexp_replace(F.lower("text"), r"[\d\s\p{P}]+", ""))
    return cut(docs.select("doc_id", norm_source("source").alias("source"), F.when(F.col("text").isNotNull(), same).alias("k"), "text").mapInArrow(run, "doc_id bigint, source string, k bigint, u binary"))


def _units(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, "<u4") for x in column.to_pylist())


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Model of unit_rows() and the labels (doc_id, toxic)."""
    share = rows.sparkSession.sparkContext.broadcast
    # copies of a text would make its chance words look telling, so each text counts once
    judged = rows.where("k is not null").join(F.broadcast(majority(labels)), "doc_id").groupBy("k").agg(F.min("u").alias("u"), F.avg(F.col("toxic").cast("double")).alias("share"))
    marked = cut(judged.where("share != 0.5").select((F.col("share") > 0.5).alias("toxic"), "u"))
    n_docs = rows.where("k is not null").count()
    tally = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    n_tox, n_ok = tally.get(True, 0), tally.get(False, 0)

    def both(b: pa.RecordBatch):
        for toxic, u in zip(b.column(0).to_pylist(), _units(b.column(1))):
            yield all_grams(u), float(toxic), float(not toxic)

    odds = math.log((n_tox + 0.5) / (n_ok + 0.5))
    q = (n_tox + 0.5) / (n_tox + n_ok + 1)
    pure = F.log((F.col("t") + PRIOR_LABELS * q) / (F.col("f") + PRIOR_LABELS * (1 - q))) - odds > PURITY
    g = _sums(marked, ["t", "f"], both).where((F.col("t") >= 2) & pure).toPandas().sort_values("h")  # grams of two of MAX_LABELLED texts or more
    keys = g.h.to_numpy(np.int64)
    shared = share(keys)

    def common(b: pa.RecordBatch):
        for u in _units(b.column(0)):
            yield known(shared.value, u), 1.0

    n = np.zeros(len(keys))
    if len(keys):
        df = _sums(rows.where("k is not null").select("u"), ["n"], common).toPandas()
        n[df.h.to_numpy(np.int64)] = df.n.to_numpy(float)
    m = Model(n_tox, n_ok, keys, g.t.to_numpy(float), g.f.to_numpy(float), (n + 0.5) / (n_docs + 1))
    for _ in range(CONFIRM_ROUNDS):
        model = share(m)

        def beside(b: pa.RecordBatch, model=model):
            for u in _units(b.column(0)):
                yield model.value.confirmed(u), 1.0

        df = _sums(marked.where("toxic").select("u"), ["n"], beside).toPandas()
        sure = np.zeros(len(m.keys))
        sure[df.h.to_numpy(np.int64)] = df.n.to_numpy(float)
        m.keep(sure)
    model = share(m)

    def near(b: pa.RecordBatch):
        for toxic, u in zip(b.column(0).to_pylist(), _units(b.column(1))):
            yield np.unique(model.value.contexts(u, model.value.hits(u))[1]), float(toxic), float(not toxic)

    ctx = _sums(marked, ["t", "f"], near).where("f >= 1").toPandas().sort_values("h")
    m.ctx_keys, m.ctx_tox, m.ctx_ok = ctx.h.to_numpy(np.int64), ctx.t.to_numpy(float), ctx.f.to_numpy(float)
    _calibrate(m, marked)
    discard(marked)
    return m


def _calibrate(m: Model, marked: DataFrame) -> None:
    """Gumbel law of harmless texts' best scores by moments, and the p-value that best tells the labelled texts apart, each scored without its own label."""
    model = marked.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [model.value.best(u, t)[:2] for t, u in zip(b.column(0).to_pylist(), _units(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in r], pa.float64()), pa.array([x[1] for x in r], pa.int64())], names=["toxic", "score", "n"])

    law(m, marked.mapInArrow(run, "toxic boolean, score double, n bigint").toPandas())


def law(m: Model, s: pd.DataFrame) -> None:
    y = s.toxic.to_numpy(bool)
    ok = s[~y]
    if len(ok) < 20 or not y.any():
        return  # nothing to tell apart: the limit stays 0 and flags no text
    body = ok.score[ok.score <= ok.score.quantile(0.97)]  # raters err: the top may hold toxic texts
    spread = max(float(body.std()), 0.3)
    m.scale = math.pi / (spread * math.sqrt(6))
    m.shift = m.scale * float(body.mean()) - 0.5772 - float(np.log(ok.n.clip(lower=20)).mean())
    p = np.array([m.p_value(a, b) for a, b in zip(s.score, s.n)])
    best = (-1.0, 0.0)
    for at_most in np.geomspace(1e-10, 0.3, 80):  # of equal cuts the strictest
        hit = p <= at_most
        f1 = 2 * (hit & y).sum() / max(1, hit.sum() + y.sum())
        best = max(best, (f1, -at_most))
    m.limit = -best[1]


SCORES = "doc_id bigint, source string, score double, p_value double, n_passages int, from_unit int, to_unit int, toxic boolean"


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Per row: score of the best segment, its p-value, number of significant passages, the units of the best one (null for none), and the verdict."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for u in _units(b.column(2)):
                s, n, seg = m.best(u)
                good = [g for g in seg if m.p_value(g[2], n) <= m.limit]
                top = max(good, key=lambda g: g[2], default=None)
                for c, v in zip(cols, (s, m.p_value(s, n), len(good), top and top[0], top and min(len(u), top[1] + ORDERS - 1), bool(good))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())))], names=[f.split()[0] for f in SCORES.split(", ")])

    return rows.select("doc_id", "source", F.coalesce("u", F.lit(b"")).alias("u")).mapInArrow(run, SCORES)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = unit_rows(docs)
    return score(rows, fit(rows, labels))


def passages(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """scores with `passage` instead of its units: that part of the flagged text, disguises taken off; of a doc_id's several texts the least."""

    @F.pandas_udf("string")
    def part(text: pd.Series, a: pd.Series, z: pd.Series) -> pd.Series:
        out = []
        for x, i, j in zip(text, a, z):
            t = bare(x)
            at_ = [w.span() for w in _UNIT.finditer(t)][int(i) : int(j)]
            out.append(t[at_[0][0] : at_[-1][1]] if at_ else None)
        return pd.Series(out, dtype=object)

    hit = scores.where("toxic").select("doc_id", "from_unit", "to_unit").dropDuplicates(["doc_id"])
    read = docs.select("doc_id", "text").join(hit, "doc_id").groupBy("doc_id", "from_unit", "to_unit").agg(F.min("text").alias("text"))
    shown = read.select("doc_id", part("text", "from_unit", "to_unit").alias("passage"))
    return scores.drop("from_unit", "to_unit").join(shown, "doc_id", "left")


def rates(scores: DataFrame) -> DataFrame:
    """Per source (null for none): documents, toxic ones and their rate."""
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("toxic").cast("bigint")).alias("n_toxic"), F.avg(F.col("toxic").cast("double")).alias("toxic_rate"))


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).where("toxic").select("doc_id")
