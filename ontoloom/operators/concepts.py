"""Concept decisions and merging: granularity, layer, identity, exact and similar names, representatives, neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.text import lcs_length, ngrams, substrings, trim
from ontoloom.operators.graph import components
from ontoloom.session import cut

#: Words that mark the logic and the application layer.
LOGIC = "状态|流程|规则|策略|计算|校验|审核|status|workflow|rule|policy|validation"
APPLICATION = "页面|界面|按钮|表单|通知|提醒|导航|page|form|button|notification|ui|view"


def layer(name: Column, name_en: Column, source: Column, has_table: Column) -> Column:
    """data, logic or application; a relational concept with a table is data, keywords decide next, then texts count as logic."""
    n = F.concat_ws(" ", F.lower(name), F.lower(name_en))
    return F.when((source == "rdb") & has_table, "data").when(n.rlike(LOGIC), "logic").when(n.rlike(APPLICATION), "application").when(source == "text", "logic").otherwise("data")


def granularity(concepts: DataFrame, queried: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(id, decision, confidence): few instances merge into the hinted parent or wait; unmentioned weak ones too; short names that are another concept's alias are property values; the rest stay.

    concepts: id, name, name_en, aliases, instance_count, confidence; queried: term; hints: id of concepts with a parent."""
    key = F.lower(trim("name"))
    alias = concepts.select(F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("a"), F.col("id").alias("other")).select(F.lower(trim("a")).alias("k"), "other").groupBy("k").agg(F.count_distinct("other").alias("n_others"), F.min("other").alias("least_other"))
    asked = queried.select(F.lower("term").alias("k")).distinct().withColumn("asked", F.lit(True))
    c = concepts.withColumn("k", key).join(alias, "k", "left").join(asked.withColumnRenamed("k", "en"), F.lower("name_en") == F.col("en"), "left")
    c = c.join(hints.select("id").distinct().withColumn("hint", F.lit(True)), "id", "left") if hints is not None else c.withColumn("hint", F.lit(None).cast("boolean"))
    foreign = (F.col("n_others") > 1) | ((F.col("n_others") == 1) & (F.col("least_other") != F.col("id")))
    weak = F.coalesce("asked", F.lit(False)) == F.lit(False)
    small = F.coalesce("instance_count", F.lit(0)) < 3
    held = F.when(F.coalesce("hint", F.lit(False)), "merge_into_parent").otherwise("pending")
    d = F.when(small, held).when(weak & (F.col("confidence") < 0.6), held).when((F.length(trim("name")) <= 3) & F.coalesce(foreign, F.lit(False)), "property_value").otherwise("keep")
    return c.withColumn("decision", d).select("id", "decision", F.round(F.when(F.col("decision") == "pending", F.col("confidence") * 0.7).otherwise(F.col("confidence")), 6).alias("confidence"))


def merge_exact(concepts: DataFrame) -> DataFrame:
    """(component, id): concepts whose names are equal but for case and surrounding blanks; the component is the least id."""
    k = F.lower(trim("name"))
    g = concepts.where("name is not null").groupBy(k.alias("k")).agg(F.min("id").alias("component"))
    return concepts.where("name is not null").withColumn("k", k).join(g, "k").select("component", "id")


#: Counters of token frequency that are broadcast, whatever the number of tokens.
COUNTERS = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tokens(name: str) -> np.ndarray:
    """A name's characters, numbered where they recur, each as one number."""
    seen: dict[str, int] = {}
    out = np.empty(len(name), np.uint64)
    for i, ch in enumerate(name):
        seen[ch] = k = seen.get(ch, -1) + 1
        out[i] = ord(ch) << 32 | k
    return out


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens * _MIX >> np.uint64(48)).astype(np.int64)


def _signatures(tokens: list[np.ndarray]) -> np.ndarray:
    """Two words for each set of tokens: the parities of how many fall on each of 128 bits, so sets differ in as many tokens as bits at least."""
    n = np.array([len(t) for t in tokens], np.int64)
    h = np.concatenate([*tokens, np.zeros(0, np.uint64)]) * np.uint64(0xC2B2AE3D27D4EB4F)
    bits = (h ^ h >> np.uint64(29)) * _MIX >> np.uint64(57)
    out = np.zeros((2, len(n)), np.uint64)
    for word in (0, 1):
        one = np.where(bits >> np.uint64(6) == word, np.uint64(1) << (bits & np.uint64(63)), np.uint64(0))
        if len(one):
            out[word][n > 0] = np.bitwise_xor.reduceat(one, (np.cumsum(n) - n)[n > 0])
    return out


def _edits(threshold: float, size: int) -> int:
    """Most insertions and deletions between two names of together size characters."""
    return int((1 - threshold) * size + 1e-9)


@cache
def _head(threshold: float, n: int) -> int:
    """How many of the rarest tokens of a name of n characters hold the rarest one that it shares with any similar name."""
    low, high = math.ceil(n * threshold / (2 - threshold) - 1e-9), int(n * (2 - threshold) / threshold + 1e-9)
    return n + 1 - min(-(-(n + m - _edits(threshold, n + m)) // 2) for m in range(low, high + 1))


def _counts(keyed: DataFrame) -> np.ndarray:
    """Sums of n by counter k of (k, n)."""
    got = keyed.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def _counted(batches: Iterator[pa.RecordBatch], keys: Callable[[str], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.bincount(np.concatenate([*map(keys, b.column(0).to_pylist()), np.zeros(0, np.int64)]), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["k", "n"])


def _near(names: list[str], key: int, counts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of similar names whose rarest common token is key."""
    order = sorted(range(len(names)), key=lambda i: len(names[i]))
    tokens = [_tokens(names[i]) for i in order]
    mine = (int(counts[_counter(np.array([key], np.uint64))[0]]), key)
    rarer = cache(lambda i: {t for c, t in zip(counts[_counter(tokens[i])].tolist(), tokens[i].tolist()) if (c, t) < mine})
    sig, size = _signatures(tokens), np.array([len(x) for x in tokens])
    sizes, first = np.unique(size, return_index=True)
    end = [*first[1:].tolist(), len(size)]
    for p, n in enumerate(sizes.tolist()):
        for q in range(p, len(sizes)):
            m = int(sizes[q])
            d = _edits(threshold, n + m)
            if m - n > d:
                break
            for i in range(int(first[p]), end[p], 64):
                x = slice(i, min(i + 64, end[p]))
                for j in range(int(first[q]) if q > p else i, end[q], 4096):
                    y = slice(j, min(j + 4096, end[q]))
                    u, v = np.nonzero(np.bitwise_count(sig[0][x, None] ^ sig[0][None, y]) <= d)
                    u, v = u + i, v + j
                    keep = (u < v) & (np.bitwise_count(sig[0][u] ^ sig[0][v]) + np.bitwise_count(sig[1][u] ^ sig[1][v]) <= d)
                    for k, l in zip(u[keep].tolist(), v[keep].tolist()):
                        if rarer(k).isdisjoint(rarer(l)):
                            a, b = names[order[k]], names[order[l]]
                            lcs = lcs_length(a, b)
                            if n + m - 2 * lcs <= d:
                                yield order[k], order[l], 2 * lcs / (n + m)


def _forest(links: Iterable[tuple[int, int, float]], n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many links each of n members has, and as few of the links as join the same."""
    count, up, kept = np.zeros(n, np.int64), list(range(n)), []
    for i, j, _ in links:
        count[i] += 1
        count[j] += 1
        a, b = i, j
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            kept.append((i, j))
    return count, kept


def similar_names(names: DataFrame, threshold: float = 0.85, summed: bool = False) -> DataFrame:
    """(a, b, ratio): links between different names of InDel ratio of threshold or more; names: name, distinct.

    An insertion or deletion changes one of a name's characters (numbered where they recur), so of similar names the
    rarest common one is among the few rarest of either (_head).  Names meet there, once, and are compared by signatures
    first; what these don't tell apart is verified.  Nothing but a name per rare character is shuffled.  summed: (a, b, n)
    instead, with as many of the links as join the same names, b null in rows that give how many links (n) of a name
    were found at one place; pairs then never leave the task that finds them."""
    t = names.where("name != ''").select("name")
    counts = _counts(t.mapInArrow(lambda batches: _counted(batches, lambda x: _counter(_tokens(x))), "k bigint, n bigint"))
    shared = names.sparkSession.sparkContext.broadcast(counts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, keys = [], []
            for i, x in enumerate(b.column(0).to_pylist()):
                k = _tokens(x)
                head = k[np.lexsort((k, shared.value[_counter(k)]))][: _head(threshold, len(x))]
                idx.append(np.full(len(head), i))
                keys.append(head)
            if idx:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), b.column(0).take(pa.array(np.concatenate(idx)))], names=["k", "name"])

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        x = group["name"].to_pylist()
        near = _near(x, key[0].as_py(), shared.value, threshold)
        if not summed:
            found = [(min(x[i], x[j]), max(x[i], x[j]), round(r, 6)) for i, j, r in near]
            return pa.table({k: pa.array([f[c] for f in found], kind) for c, (k, kind) in enumerate((("a", pa.string()), ("b", pa.string()), ("ratio", pa.float64())))})
        count, kept = _forest(near, len(x))
        some = np.flatnonzero(count).tolist()
        return pa.table({"a": pa.array([x[i] for i in some] + [x[i] for i, _ in kept], pa.string()), "b": pa.array([None] * len(some) + [x[j] for _, j in kept], pa.string()), "n": pa.array([*count[some].tolist(), *[0] * len(kept)], pa.int64())})

    return t.mapInArrow(spread, "k bigint, name string").groupBy("k").applyInArrow(meet, "a string, b string, " + ("n bigint" if summed else "ratio double"))


def cosine_links(vectors: DataFrame, threshold: float = 0.85, judge_from: float | None = None) -> DataFrame:
    """(a, b, cosine): pairs of different ids whose sparse unit vectors (id, bucket, weight; hash_embed) have a cosine of threshold or more, or of judge_from.

    Leaving out of a vector the commonest buckets whose norm is below the threshold loses no partner: some bucket of the
    rest must be in the other vector too.  So only the rare rest of each is joined, and what meets is verified by the
    dot product over shared buckets."""
    least = threshold if judge_from is None else judge_from
    df = vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("id").orderBy(F.desc("df"), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    heads = vectors.join(df, "bucket").withColumn("light", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w))).where(F.col("light") >= least - 1e-4)
    v = vectors.select("bucket", F.col("id").alias("other"))
    pairs = cut(heads.select("bucket", "id").join(v, "bucket").where("id != other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    x, y = vectors.select(F.col("id").alias("a"), "bucket", F.col("weight").alias("u")), vectors.select(F.col("id").alias("b"), "bucket", F.col("weight").alias("v"))
    c = pairs.join(x, "a").join(y, ["b", "bucket"]).groupBy("a", "b").agg(F.round(F.sum(F.col("u") * F.col("v")), 4).alias("cosine"))
    return c.where(F.col("cosine") >= least)


def _grams(text: str) -> dict[int, float]:
    """hash_embed's vector of a text by gram, grams as numbers."""
    c = [ord(x) + 1 for x in text]
    s: dict[int, float] = {}
    for i in range(len(c) - 1):
        k = c[i] << 42 | c[i + 1] << 21
        s[k] = s.get(k, 0.0) + 0.5
        if i + 2 < len(c):
            s[k | c[i + 2]] = s.get(k | c[i + 2], 0.0) + 1.0
    norm = math.sqrt(sum(x * x for x in s.values()))
    return {k: round(x / norm, 6) for k, x in s.items()}


def _alike(texts: list[str], key: int, counts: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, cosine) of texts whose rarest common gram is key."""
    vectors = [_grams(t) for t in texts]
    bits, unit = np.zeros((2, len(texts)), np.uint64), np.ones(len(texts))
    for i, v in enumerate(vectors):
        long = [k for k in v if k & 0x1FFFFF]
        if long:
            unit[i] = min(v[k] for k in long) ** 2
            h = 0
            for k in long:
                h |= 1 << (k * 0x9E3779B97F4A7C15 >> 57 & 127)
            bits[0, i], bits[1, i] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
    lacks = lambda x, y: sum(np.bitwise_count(w[x, None] & ~w[None, y]).astype(np.float32) for w in bits)
    for i in range(0, len(texts), 64):
        x = slice(i, i + 64)
        for j in range(i, len(texts), 4096):
            y = slice(j, j + 4096)
            # what either has alone is no part of the product
            most = np.maximum(1 - lacks(x, y) * unit[x, None], 0) * np.maximum(1 - lacks(y, x).T * unit[None, y], 0)
            for u, v in zip(*(k.tolist() for k in np.nonzero(most >= (least - 1e-3) ** 2))):
                if u + i < v + j:
                    a, b = vectors[u + i], vectors[v + j]
                    common = a.keys() & b.keys()
                    cosine = round(sum(a[g] * b[g] for g in sorted(common)), 4)
                    if cosine >= least:
                        g = np.array(sorted(common), np.uint64)
                        if int(g[np.argmin(counts[_counter(g)])]) == key:
                            yield u + i, v + j, cosine


def cosine_texts(texts: DataFrame, threshold: float = 0.85, summed: bool = False) -> DataFrame:
    """(a, b, cosine): pairs of ids of texts (id, text) whose vectors (hash_embed by grams) have a cosine of threshold or more.

    The commonest grams of a text whose norm is below the threshold are left out: the rarest gram that a pair shares is
    in the rest of either.  Texts meet there, once; bitmaps of their grams bound the cosine of most, the others are
    verified.  A text per rare gram is all that is shuffled.  summed: only as many pairs of each task as join the same."""
    t = texts.where("text is not null and length(text) >= 2").select("text", "id")
    keys = lambda x: _counter(np.fromiter(_grams(x), np.uint64))
    shared = texts.sparkSession.sparkContext.broadcast(_counts(t.mapInArrow(lambda batches: _counted(batches, keys), "k bigint, n bigint")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, out = [], []
            for i, x in enumerate(b.column(0).to_pylist()):
                v = _grams(x)
                k, w = np.fromiter(v, np.uint64), np.fromiter(v.values(), float)
                order = np.lexsort((k, shared.value[_counter(k)]))[::-1]
                head = k[order][np.sqrt(np.cumsum(w[order] ** 2)) >= threshold - 1e-3]
                idx.append(np.full(len(head), i))
                out.append(head)
            if idx:
                at = pa.array(np.concatenate(idx))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64)), b.column(1).take(at), b.column(0).take(at)], names=["k", "id", "text"])

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        ids = group["id"].to_pylist()
        near = _alike(group["text"].to_pylist(), key[0].as_py(), shared.value, threshold)
        found = [(i, j, None) for i, j in _forest(near, len(ids))[1]] if summed else list(near)
        return pa.table({"a": pa.array([min(ids[i], ids[j]) for i, j, _ in found], pa.string()), "b": pa.array([max(ids[i], ids[j]) for i, j, _ in found], pa.string()), "cosine": pa.array([c for *_, c in found], pa.float64())})

    return t.mapInArrow(spread, "k bigint, id string, text string").groupBy("k").applyInArrow(meet, "a string, b string, cosine double")


def merge_similar(concepts: DataFrame, threshold: float = 0.85, more: DataFrame | None = None) -> DataFrame:
    """(id, component, n_links): classes of concepts joined by equal or similar names, and by the links `more` (a, b: ids) of vectors or a judge, transitively; n_links counts the similar names of the concept's own."""
    named = concepts.where("name is not null").select("id", F.lower(trim("name")).alias("name"))
    names = cut(named.select("name").distinct())
    links = cut(similar_names(names, threshold, summed=True))
    every = links.where("b is not null").select("a", "b")
    if more is not None:
        by_id = more.select("a", "b").join(named.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
        every = every.unionByName(by_id.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()
    comp = components(names.withColumnRenamed("name", "id"), every).withColumnRenamed("id", "name")
    least = named.join(comp, "name").groupBy("component").agg(F.min("id").alias("c"))
    n = links.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n_links"))
    return named.join(comp, "name").join(least, "component").join(n, "name", "left").select("id", F.col("c").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(concepts: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, name, confidence, description, aliases, n_members): the most confident member's name (ties to the least id), the first description by id, and all other names and aliases."""
    j = concepts.join(groups.select("component", "id"), "id")
    best = j.groupBy("component").agg(F.min_by("name", F.struct(-F.coalesce("confidence", F.lit(0.0)), F.col("id"))).alias("name"), F.max("confidence").alias("confidence"), F.min_by("description", F.struct(F.coalesce(F.col("description") == "", F.lit(True)), F.col("id"))).alias("description"), F.count(F.lit(1)).alias("n_members"))
    other = j.select("component", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).where("a is not null and a != ''").distinct().join(best.select("component", F.col("name").alias("rep")), "component").where("a != rep")
    al = other.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("a")), "|").alias("aliases"))
    return best.join(al, "component", "left").select("component", "name", "confidence", "description", F.coalesce("aliases", F.lit("")).alias("aliases"), "n_members")


def hash_embed(texts: DataFrame, dim: int | None = 384) -> DataFrame:
    """(id, bucket, weight): L2-normalised bigrams (weight 1/2) and trigrams (1) of a text, hashed to dim buckets or, for None, as they are; long form; texts without two characters have no row."""
    g = F.concat(F.transform(ngrams(F.col("text"), 3), lambda x: F.struct(x.alias("g"), F.lit(1.0).alias("w"))), F.transform(ngrams(F.col("text"), 2), lambda x: F.struct(x.alias("g"), F.lit(0.5).alias("w"))))
    b = F.pmod(F.conv(F.substring(F.md5("x.g"), 1, 8), 16, 10).cast("bigint"), F.lit(dim)) if dim else F.col("x.g")
    s = texts.where("text is not null").select("id", F.explode(g).alias("x")).groupBy("id", b.alias("bucket")).agg(F.sum("x.w").alias("s"))
    return s.withColumn("norm", F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("id")))).select("id", "bucket", F.round(F.col("s") / F.col("norm"), 6).alias("weight"))


BLOCK = 1024


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Search: (query_id, vec_id, similarity) of the `top` vectors of greatest cosine for each query, against all vectors; ties to the least id.

    Queries go out in blocks of 1024, each broadcast alone (dimension x 1024 numbers); every stream of vectors keeps its
    own best `top` per query, and only these are shuffled.  Zero vectors have cosine 0."""
    spark = vectors.sparkSession
    n = queries.count()
    out = None
    for k in range(max(1, math.ceil(n / BLOCK))):
        q = queries.select(F.col(key).alias("q"), F.col(column).alias("v"), F.row_number().over(Window.orderBy(key)).alias("r")).where((F.col("r") > k * BLOCK) & (F.col("r") <= (k + 1) * BLOCK)).toPandas() if n > BLOCK else queries.select(F.col(key).alias("q"), F.col(column).alias("v")).toPandas()
        block = (q.q.to_numpy(np.int64), np.stack([np.asarray(v, float) for v in q.v]) if len(q) else np.zeros((0, 1)))
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            norm = np.linalg.norm(m, axis=1)
            best_s, best_i = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                x = np.stack([np.asarray(v, float) for v in b.column(1).to_pylist()])
                d = norm[:, None] * np.linalg.norm(x, axis=1)[None, :]
                s = np.round(np.divide(m @ x.T, d, out=np.zeros_like(d), where=d > 0), 9)
                i = np.broadcast_to(np.asarray(b.column(0).to_pylist(), np.int64), s.shape)
                best_s, best_i = np.hstack([best_s, np.where(i == ids[:, None], -9.0, s)]), np.hstack([best_i, i])
                order = np.lexsort((best_i, -best_s), axis=1)[:, :top]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            w = best_s.shape[1]
            keep = best_s.ravel() > -2
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, w)[keep]), pa.array(best_i.ravel()[keep].astype(np.int64)), pa.array(best_s.ravel()[keep])], names=["query_id", "vec_id", "similarity"])

        part = vectors.where(F.col(column).isNotNull()).select(key, column).mapInArrow(run, "query_id bigint, vec_id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def substring_hierarchy(concepts: DataFrame) -> DataFrame:
    """(child, parent, confidence): names that contain another, with fewer instances; joined by equality of substrings, not pairwise; concepts: name, instance_count."""
    n = concepts.where("name is not null and instance_count > 0").groupBy("name").agg(F.max("instance_count").alias("n"))
    p = n.select(F.col("name").alias("parent"), F.lower("name").alias("k"), F.col("n").alias("pn"))
    c = substrings(n.select(F.col("name").alias("child"), F.col("n").alias("cn")), "child", p)
    return c.join(p, "k").where("child != parent and cn < pn and contains(child, parent)").select("child", "parent", F.lit(0.6).alias("confidence"))
