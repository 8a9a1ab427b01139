"""Problem 4: matching entities across sources without keys.

The sources name a thing by the same few attributes in other words, some of them as code names whose words stand in a
fixed order.  How many attributes there are is learned from the code names: neighbouring words that tell each other are
one attribute's.  From the records that carry a code name, what the free text says of each place in the code is learned:
the weight of evidence of every run of one to three characters for every code word.  That reads noisy names, aliases and
descriptions of all sources into one tuple of attributes with gaps.

Candidate pairs agree on all attributes but one, which one of them may lack; they get log-odds from how rare what they
agree on is (Fellegi-Sunter) and from the field names they mention.  Loopy belief propagation over the candidates with a
one-to-one factor for each record and other source then exchanges messages until they stay, and the marginal
probability of each pair is its confidence.

Results: copies of a record (same id) are one, the latest loaded holds; a record without any text has no attributes and
matches nothing; records of the same source never match, nor does anything where no record has a code name; pairs need all
known attributes but one in common, since fewer leave the marginal below the threshold in any corpus of over some
thousand things.  Records of a source with the same
attributes and field names can't be told apart: they are one class, whose messages are counted as often as it has members.
"""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.ids import norm_id
from ontoloom.session import cut, discard

#: Latin words that make a name a code name, and how much of one word's uncertainty its neighbour must take away for both to be one attribute.
LEAST_WORDS = 3
BOUND = 0.8
#: Share of the code names that must have a place for it to be an attribute, and words of a name that are looked at.
REACHED, MOST_PLACES = 0.2, 64
LEAST_COUNT = 5
LEAST_GLUED = 3
PRECISION = 0.6
SURE = 0.8
RIVAL = 0.6
PART_OF = 0.4
THRESHOLD = 0.5
PRIOR = 0.6
FIELDS_AGREE, FIELDS_DIFFER = 1.5, -3.5
#: Rounds of propagation; from half of them on, messages move by a quarter only.
MAX_ROUNDS = 100
STILL = 0.001
#: Most code words and runs of characters that are broadcast; more are an error, not a loss.
MOST_WORDS, MOST_RUNS = 2_000_000, 5_000_000

_HAN = re.compile("[㐀-鿿]+")
_RUN = re.compile("(?:(?<![a-z])[a-z]{1,2}(?=[㐀-鿿]))?[㐀-鿿]+")  # one or two letters may lead, as in PC端
#: Marks runs of a description, which speaks of more than the thing itself and is learned apart from names.
FROM_TEXT = "·"
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_FIELD = re.compile(r"\b[a-z]+(?:_[a-z]+)+\b")


def words(text: str) -> list[str]:
    """Latin words of a text, camel case taken apart."""
    return [w for w in re.split(r"[^a-z]+", _CAMEL.sub(r"\1_\2", unicodedata.normalize("NFKC", text)).lower()) if w]


def code_parts(text: str, layout: tuple[int, ...]) -> list[tuple[int, str]]:
    """(place, words) of a code name, read from the right."""
    w, out = words(text), []
    end = len(w)
    for slot, n in enumerate(layout):
        if end - n < 0:
            break
        out.append((slot, "_".join(w[end - n : end])))
        end -= n
    return out


def is_code(text: str | None) -> bool:
    return bool(text) and not _HAN.search(text) and len(words(text)) >= LEAST_WORDS


def codes_of(name, name_en, aliases, ref) -> list[str]:
    out = [t for t in (name, name_en, *(aliases or [])) if is_code(t)]
    if ref and ":" in ref and is_code(ref.partition(":")[2]):
        out.append(ref.partition(":")[2])
    return out


def keys_in(text: str, vocab: dict[str, int], widest: int) -> dict[int, set[str]]:
    """Known code words in a text by place, the longest first; a prefix glued to the first word is passed over."""
    w, out, i = words(text), defaultdict(set), 0
    while i < len(w):
        for n in range(widest, 0, -1):
            k = "_".join(w[i : i + n])
            hit = k if k in vocab else k[1:] if i == 0 and k[1:] in vocab else None
            if hit and len(w[i : i + n]) == n:
                out[vocab[hit]].add(hit)
                i += n - 1
                break
        i += 1
    return out


def runs(names: list[str], description: str | None) -> set[str]:
    """Runs of one to three characters of the names and, marked, of the description."""

    def of(text: str) -> set[str]:
        return {z[i : i + n] for z in _RUN.findall(unicodedata.normalize("NFKC", text).lower()) for n in (1, 2, 3) for i in range(len(z) - n + 1)}

    return {g for t in names for g in of(t)} | {FROM_TEXT + g for g in of(description or "")}


def latest(concepts: DataFrame) -> DataFrame:
    """One row per id: id, src, name, name_en, aliases, description, source_ref, fields."""
    cols = ["source", "name", "name_en", "aliases", "description", "source_ref", "properties", "identity_spec"]
    one = concepts.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "name", "description")).alias("v")).select("id", "v.*")
    return one.withColumn("src", norm_id("source")).where("src is not null").drop("source")


_TEXTS = ["name", "name_en", "aliases", "description", "source_ref"]


def learn_layout(records: DataFrame) -> tuple[int, ...]:
    """Words per place of a code name, from its right end; () where no code name is.

    Places that under REACHED of the code names get to hold prefixes.  Each word's entropy and what it has in common with
    its left neighbour are measured over all records; words that tell each other (BOUND) share a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple, int] = defaultdict(int)
            for name, en, al, _, ref in zip(*(b.column(c).to_pylist() for c in range(5))):
                for t in set(codes_of(name, en, al, ref)):
                    w = words(t)[::-1]
                    for i, x in enumerate(w):
                        n[i, x, w[i + 1] if i + 1 < len(w) else None] += 1
            ks = list(n)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in ks], t) for c, t in enumerate((pa.int32(), pa.string(), pa.string()))), pa.array([n[k] for k in ks], pa.int64())], names=["i", "word", "next", "n"])

    c = cut(records.select(*_TEXTS).mapInArrow(run, "i int, word string, next string, n bigint").groupBy("i", "word", "next").agg(F.sum("n").alias("n")))
    reach = {r.i: r.n for r in c.groupBy("i").agg(F.sum("n").alias("n")).where(F.col("i") < MOST_PLACES).collect()}
    if not reach:
        return ()
    n_words = max(i for i, n in reach.items() if n >= REACHED * reach[0]) + 1
    told = c.where((F.col("n") >= 2) & F.col("next").isNotNull() & (F.col("i") < n_words - 1))  # slips of writing occur once
    bits = lambda *keys: {r.i: r.h for r in told.groupBy("i", *keys).agg(F.sum("n").alias("n")).groupBy("i").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h")).collect()}
    left, right, both = bits("next"), bits("word"), bits("word", "next")
    out = [1]
    for i in range(n_words - 1):
        least = min(left.get(i, 0.0), right.get(i, 0.0))
        common = left.get(i, 0.0) + right.get(i, 0.0) - both.get(i, 0.0)
        if least > 0 and common >= BOUND * least:
            out[-1] += 1
        else:
            out.append(1)
    discard(c)
    return tuple(out)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of df, of which there must be `most` at most."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} {what}: more than a broadcast may hold")
    return rows


def vocabulary(records: DataFrame, layout: tuple[int, ...]) -> dict[str, int]:
    """Place of each code word that stands in LEAST_COUNT records or more, however frequent others are; no words with a prefix glued on (keys_in)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple[int, str], int] = defaultdict(int)
            for name, en, al, _, ref in zip(*(b.column(c).to_pylist() for c in range(5))):
                for part in {p for t in codes_of(name, en, al, ref) for p in code_parts(t, layout)}:
                    n[part] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["slot", "word", "n"])

    counts = records.select(*_TEXTS).mapInArrow(run, "slot int, word string, n bigint").groupBy("slot", "word").agg(F.sum("n").alias("n"))
    rows = bounded(counts.where(F.col("n") >= LEAST_COUNT), MOST_WORDS, "code words")
    best: dict[str, tuple[int, int]] = {}
    for r in rows:  # a word belongs to the place where it is most frequent
        if r.n > best.get(r.word, (0, 0))[0]:
            best[r.word] = (r.n, r.slot)
    bare: dict[str, set[str]] = defaultdict(set)  # letters that lead several words of the leftmost place: a prefix, not a part of the word
    for w, (n, s) in best.items():
        if s == len(layout) - 1 and best.get(w[1:], (0, -1))[1] == s and best[w[1:]][0] > n:
            bare[w[0]].add(w)
    glued = {w for ws in bare.values() if len(ws) >= LEAST_GLUED for w in ws}
    return {w: s for w, (_, s) in best.items() if w not in glued}


def lexicon(records: DataFrame, vocab: dict[str, int], layout: tuple[int, ...]) -> dict[int, dict[str, tuple[str, float, float, tuple]]]:
    """Per place: run of characters -> (code word, precision, weight of evidence, words of other places it may belong to).  Runs rarer than one in 5000 records with a known place are left out, which bounds the lexicon by the length of a record's text."""
    shared = records.sparkSession.sparkContext.broadcast(vocab)
    slots, widest = range(len(layout)), max(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word_no: dict[tuple[int, str], int] = {}
            run_no: dict[str, int] = {"": 0}
            pairs: list[np.ndarray] = []
            for name, en, al, desc, ref in zip(*(b.column(c).to_pylist() for c in range(5))):
                keys = known_keys(name, en, al, ref, shared.value, widest)
                mine = [word_no.setdefault((s, v), len(word_no)) for s, vs in keys.items() if len(vs) == 1 for v in vs]
                if mine:
                    z = [0, *(run_no.setdefault(g, len(run_no)) for g in runs([t for t in (name, *(al or [])) if t], desc))]
                    pairs.append(np.add.outer(np.array(mine, np.int64) << 40, np.array(z, np.int64)).ravel())
            keys, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            ws, gs = list(word_no), pa.array(list(run_no), pa.string())
            w = (keys >> 40).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([ws[k][0] for k in w], pa.int32()), pa.array([ws[k][1] for k in w], pa.string()), gs.take(pa.array(keys & ((1 << 40) - 1))), pa.array(n, pa.int64())], names=["slot", "word", "g", "n"])

    c = cut(records.select(*_TEXTS).mapInArrow(run, "slot int, word string, g string, n bigint").groupBy("slot", "word", "g").agg(F.sum("n").alias("n")))
    base = {(r.slot, r.word): r.n for r in bounded(c.where("g = ''"), MOST_WORDS, "code words")}
    total = {s: sum(n for (t, _), n in base.items() if t == s) for s in slots}
    floor = F.create_map(*[x for s in slots for x in (F.lit(s), F.lit(max(4, total[s] // 5000)))])
    bare = F.length(F.ltrim(F.col("g"), F.lit(FROM_TEXT)))
    all_ = c.where("g != ''").groupBy("slot", "g").agg(F.sum("n").alias("all"), F.max_by("word", "n").alias("word"), F.max("n").alias("n"))
    rows = bounded(all_.where((F.col("n") >= floor[F.col("slot")]) & ((F.col("n") / (F.col("all") + 1) >= PRECISION) | ((bare == 1) & (F.col("n") * 4 >= F.col("all"))))), MOST_RUNS, "runs of characters")
    part_of: dict[str, list[tuple[int, str, int]]] = defaultdict(list)  # single characters that most records of a code word hold, as 日 those of 日志
    of_word = c.where("g = ''").select("slot", "word", F.col("n").alias("base"))
    for r in bounded(c.where((bare == 1) & (F.col("g") != "")).join(of_word, ["slot", "word"]).where(F.col("n") >= PART_OF * F.col("base")), MOST_RUNS, "characters"):
        part_of[r.g].append((r.slot, r.word, r.n))
    out: dict[int, dict[str, tuple[str, float, float, tuple]]] = {s: {} for s in slots}
    for r in rows:
        n, all_n, base_n = r.n, r["all"], base[r.slot, r.word]
        others = [x for x in part_of.get(r.g, ()) if x[0] != r.slot] if n / (all_n + 1) < SURE else []
        for _, _, m in others:  # records that hold the character for another place's sake, whatever stands in this one
            n, all_n = n - m * base_n / total[r.slot], all_n - m
        p = min(1.0, n / (all_n + 1)) if n > 0 < all_n else 0.0
        if p >= PRECISION:
            out[r.slot][r.g] = (r.word, p * n / (n + 1), math.log(p * total[r.slot] / base_n) * p, tuple((s, w) for s, w, _ in others))
    discard(c)
    return out


def known_keys(name, en, aliases, ref, vocab: dict[str, int], widest: int) -> dict[int, set[str]]:
    """Code words found as such in a record's code names and, written in Latin letters, in its names."""
    out: dict[int, set[str]] = defaultdict(set)
    for t in (name, en, *(aliases or []), ref.partition(":")[2] if ref and ":" in ref else None):
        if t:
            for s, v in keys_in(t, vocab, widest).items():
                out[s] |= v
    return out


def read(slot_runs: set[str], lex: dict[str, tuple], known: dict[int, str] | None = None) -> str | None:
    """The code word that the runs speak for, if any is sure enough and no rival comes near.

    A rival's runs count only where they aren't part of a run that speaks for the winner.  Characters that may belong to
    another place's word count only if `known` shows that place filled by other words."""
    says: dict[str, list[tuple[str, float, float]]] = defaultdict(list)
    for g in slot_runs:
        x = lex.get(g)
        if x and (not x[3] or known is not None and all(known.get(s) not in (None, w) for s, w in x[3])):
            says[x[0]].append((g, x[1], x[2]))
    if not says:
        return None
    score = {v: sum(x[2] for x in gs) for v, gs in says.items()}
    v = max(score, key=lambda k: (score[k], k))
    own = [g for g, _, _ in says[v]]
    rival = max((sum(w for g, _, w in gs if not any(g.lstrip(FROM_TEXT) in o for o in own)) for k, gs in says.items() if k != v), default=0.0)
    return v if max(x[1] for x in says[v]) >= SURE and rival <= RIVAL * score[v] else None


def attributes(records: DataFrame, vocab: dict[str, int], lex: dict, layout: tuple[int, ...]) -> DataFrame:
    """(id, src, s0, s1, ..., fields): the tuple of each record, null where unknown."""
    shared = records.sparkSession.sparkContext.broadcast((vocab, lex))
    places, widest = range(len(layout)), max(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lex = shared.value
        for b in batches:
            slots: list[list] = [[] for _ in places]
            fields = []
            for name, en, al, desc, ref, props, ident in zip(*(b.column(c).to_pylist() for c in range(2, 9))):
                keys = known_keys(name, en, al, ref, vocab, widest)
                z = runs([t for t in (name, *(al or [])) if t], desc)
                got = {s: next(iter(keys[s])) if len(keys.get(s, ())) == 1 else read(z, lex[s]) for s in places}
                for s in places:
                    slots[s].append(got[s] or read(z, lex[s], got))
                fields.append(sorted({x for x in (props or []) if x} | set(_FIELD.findall((desc or "").lower())) | ({ident} if ident else set())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s, pa.string()) for s in slots), pa.array(fields, pa.list_(pa.string()))], names=["id", "src", *(f"s{i}" for i in places), "fields"])

    schema = "id string, src string, " + "".join(f"s{i} string, " for i in places) + "fields array<string>"
    return records.select("id", "src", *_TEXTS, "properties", "identity_spec").mapInArrow(run, schema)


def _places(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"s\d+", c)]


def classes(attrs: DataFrame) -> DataFrame:
    """Records with all attributes known but one at most, with `class`, the least id of those with equal source, attributes and fields, and `n`, how many they are."""
    names = _places(attrs)
    known = sum(F.col(n).isNotNull().cast("int") for n in names)
    kept = attrs.withColumn("known", known).where(F.col("known") >= max(1, len(names) - 1))
    alike = ["src", *names, "fields"]
    one = kept.groupBy(*[F.col(c).alias(f"of_{c}") for c in alike]).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))  # combined before the shuffle, as copies may be many
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in alike])
    return kept.join(one, same).select(*kept.columns, "class", "n")


def candidates(attrs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, src_a, src_b, theta, n_a, n_b): pairs of classes of different sources that agree on all attributes but one and don't differ in that, with their sizes; records: classes(attrs).

    Complete records meet on their whole tuple, a record with a gap on the attributes it has, so pairs that differ are
    never made; neither are pairs of records that can't be told apart."""
    names = _places(attrs)
    slots = range(len(names))
    full = records.where("id = class")
    words_ = full.select("n", F.posexplode(F.array(*names)).alias("slot", "w")).where("w is not null").groupBy("slot", "w").agg(F.sum("n").alias("count"))
    gain = cut(words_)
    all_ = {r.slot: r["all"] for r in gain.groupBy("slot").agg(F.sum("count").alias("all")).collect()}
    for i, n in enumerate(names):
        g = gain.where(F.col("slot") == i).select(F.col("w").alias(n), F.log(F.lit(float(all_.get(i, 1))) / F.col("count")).alias(f"g{i}"))
        full = full.join(g, n, "left")
    full = cut(full.join(attrs.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("n_src")), "src"))
    key = lambda i: F.concat_ws("|", F.lit(str(i)), *[names[j] for j in slots if j != i])
    whole, part = full.where(F.col("known") == len(names)), full.where(F.col("known") < len(names))
    part = part.withColumn("key", F.coalesce(*[F.when(F.col(n).isNull(), key(i)) for i, n in enumerate(names)]))
    cols = ["id", "src", *names, *(f"g{i}" for i in slots), "fields", "n", "n_src", "key"]
    # records that know all attributes meet on the whole tuple; one with a gap meets all that agree on the rest
    tuples = whole.withColumn("key", F.concat_ws("|", F.lit("all"), *names)).select(cols)
    open_keys = part.select("key").distinct()
    blocks = whole.withColumn("key", F.explode(F.array(*[key(i) for i in slots]))).join(open_keys, "key", "left_semi").select(cols).unionByName(part.select(cols))
    x, y = tuples.alias("x"), tuples.alias("y")
    apart = F.col("x.src") != F.col("y.src")
    equal = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & apart)
    x, y = part.select(cols).alias("x"), blocks.alias("y")
    gap = F.coalesce(*[F.when(F.col(f"y.{n}").isNull(), F.lit(True)) for n in names], F.lit(False))
    near = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & (~gap | (F.col("x.id") < F.col("y.id"))))
    agree = [F.col(f"x.{n}") == F.col(f"y.{n}") for n in names]
    support = sum(F.coalesce(F.when(a, F.col(f"x.g{i}")), F.lit(0.0)) for i, a in enumerate(agree))
    shared = F.size(F.array_intersect("x.fields", "y.fields"))
    fields = F.when((F.size("x.fields") == 0) | (F.size("y.fields") == 0), 0.0).when(shared > 0, FIELDS_AGREE).otherwise(FIELDS_DIFFER)
    theta = F.lit(math.log(PRIOR)) - F.log(F.greatest("x.n_src", "y.n_src")) + support + fields
    first = F.col("x.id") < F.col("y.id")
    end = lambda c, a, b: F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    cols = [end("id", "x", "y").alias("a"), end("id", "y", "x").alias("b"), end("src", "x", "y").alias("src_a"), end("src", "y", "x").alias("src_b"), theta.alias("theta"), end("n", "x", "y").alias("n_a"), end("n", "y", "x").alias("n_b")]
    return equal.select(cols).unionByName(near.select(cols))


def propagate(pairs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(a, b, confidence): marginal probabilities by loopy belief propagation.

    The factor of record a towards source s says that at most one pair of a with s is true; its message to a pair is
    -log(1 + sum of exp(what the rival pairs send)).  Pairs without rivals are settled at once; the others exchange
    damped messages until none moves by STILL; if some still do after max_rounds, a warning says so.  With n_a and n_b, a and b stand for so many records each that have
    the same pairs, whose messages are equal too."""
    side_a, side_b = Window.partitionBy("a", "src_b"), Window.partitionBy("b", "src_a")
    if "n_a" not in pairs.columns:
        pairs = pairs.withColumn("n_a", F.lit(1)).withColumn("n_b", F.lit(1))
    p = pairs.withColumn("na", F.sum("n_b").over(side_a)).withColumn("nb", F.sum("n_a").over(side_b))
    p = cut(p.withColumn("theta", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("theta")))))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    alone = p.where("na = 1 and nb = 1").select("a", "b", logistic(F.col("theta")).alias("confidence"))
    m = p.where("na > 1 or nb > 1").drop("na", "nb").withColumn("ma", F.lit(0.0)).withColumn("mb", F.lit(0.0))
    if m.isEmpty():
        return alone
    most = math.inf
    for turn in range(max_rounds):
        step = 0.5 if turn * 2 < max_rounds else 0.25
        to_a, to_b = F.exp(F.col("theta") + F.col("mb")), F.exp(F.col("theta") + F.col("ma"))
        told = m.withColumn("ea", to_a).withColumn("eb", to_b).withColumn("ta", F.sum(F.col("ea") * F.col("n_b")).over(side_a)).withColumn("tb", F.sum(F.col("eb") * F.col("n_a")).over(side_b))
        new_a = -F.log(1 + F.greatest(F.lit(0.0), F.col("ta") - F.col("ea")))
        new_b = -F.log(1 + F.greatest(F.lit(0.0), F.col("tb") - F.col("eb")))
        moved = told.withColumn("xa", F.col("ma") + (new_a - F.col("ma")) * step).withColumn("xb", F.col("mb") + (new_b - F.col("mb")) * step)
        nxt = cut(moved.select("a", "b", "src_a", "src_b", "theta", "n_a", "n_b", F.col("xa").alias("ma"), F.col("xb").alias("mb"), F.greatest(F.abs(F.col("xa") - F.col("ma")), F.abs(F.col("xb") - F.col("mb"))).alias("change")))
        most = nxt.agg(F.max("change")).first()[0]
        discard(m if turn else None)
        m = nxt
        if most < STILL:
            break
    else:
        warnings.warn(f"belief propagation still moves by {most:.4f} after {max_rounds} rounds", RuntimeWarning, stacklevel=2)
    return alone.unionByName(m.select("a", "b", logistic(F.col("theta") + F.col("ma") + F.col("mb")).alias("confidence")))


def match(concepts: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(concept_id_a, concept_id_b, confidence) of all candidate pairs from the threshold on, concept_id_a < concept_id_b."""
    records = cut(latest(concepts))
    layout = learn_layout(records)
    if not layout:
        return records.select(F.col("id").alias("concept_id_a"), F.col("id").alias("concept_id_b"), F.lit(0.0).alias("confidence")).limit(0)
    vocab = vocabulary(records, layout)
    attrs = cut(attributes(records, vocab, lexicon(records, vocab, layout), layout))
    alike = cut(classes(attrs))
    pairs = propagate(candidates(attrs, alike)).where(F.col("confidence") >= threshold)
    x, y = (alike.select(F.col("class").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select(F.least("id_a", "id_b").alias("concept_id_a"), F.greatest("id_a", "id_b").alias("concept_id_b"), "confidence")


def found(concepts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return match(concepts, threshold).select("concept_id_a", "concept_id_b")
