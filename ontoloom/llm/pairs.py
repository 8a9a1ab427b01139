"""Problem 5: broken prompt and response pairs.

In an answer, what it takes over from its prompt becomes one mark, numbers and identifiers become another, which leaves
the template; its opening are its first clauses.  Clauses are clustered by MinHash over five-unit shingles, verified.  A
clause that recurs across unrelated prompts says nothing about any of them, and an answer whose opening has no other
clauses is a refusal, if it isn't in another language or a copy.  Prompts are unrelated if no two neighbouring units
stand in most of them, or in notably more of them than in all prompts, as the words of a common question would.  Shingles that refusals have
nearly alone find those with a clause too rare to tell.  No phrase of declining is given.  Whether an unfinished last
sentence breaks off is read from how often its last units end sentences in all answers.  Copy and language checks label
the rest.

Results: exactly one defect per pair, in the order empty, copied, refusal, other_language, truncated.  A null answer is
empty; a pair whose question is null or unknown can't be copied or in another language; rows with the same table and id
count once (the greatest answer where they differ); rows with available = false are no pairs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.session import cut, discard

OPENING_UNITS = 14
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
#: Prompts that a clause must recur across.
LEAST_PROMPTS = 6
#: How much more often than in all prompts a pair of neighbouring units may stand in a clause's n unrelated prompts: the first and the second over the root of n, which is what chance adds.
MORE, CHANCE = 0.15, 0.75
#: Share of a clause's prompts from which on a pair of units makes them related, however common it is in all.
MOST_ALIKE = 0.6
#: Unmarked units of a clause that can be refused with: shorter answers (yes, none found) may be any prompt's.
OWN_UNITS = 4
ENDS = 0.05
RECURS = 3
SHORT = 12

#: What stands in for an answer.
STAND_INS = set("na none null nan nil undefined empty 空 无回答 无答案 暂无 暂无回答 暂无答案 待补充 待填写 未作答 未回答 没有回答 noanswer tbd todo blank missing notavailable 空白 无内容 答案缺失".split())
#: Words that lead in the question only.
LEAD_INS = set("您问的是 你问的是 您的问题是 你的问题是 问题是 问题 问 您问 question q youasked yourquestion yourquestionis yourquestionwas thequestionis thequestion youareasking 你问 关于 on about".split())
#: Share of a shingle's answers that must be refusals for it to tell others.
MOSTLY = 0.6

_HAN = "㐀-鿿"
_UNIT = re.compile(rf"[{_HAN}]|[^\W\d_]+(?:['’][a-z]+)?|\d+(?:[.,]\d+)*|[^\w\s]|\n")
_STOP = set("。！？!?；;\n…")
_PAUSE = set("，,：:")
CLAUSE = " | "
_BULLETS = re.compile(r"(?m)^[\s]*[-*•·‣][\s]+")
_LATIN = re.compile(rf"[^\W\d_{_HAN}぀-ヿ가-힯Ѐ-ӿ؀-ۿ฀-๿]{{2,}}")
_IDENTIFIER = re.compile(r"\b\w*(?:_\w+)+|\b[a-z]+(?:[A-Z][a-z0-9]*)+\b|\b\w+\([^)]*\)|“[^”]*”|\"[^\"]*\"|`[^`]*`")
#: Frequent words of languages written in Latin letters.
WORDS = {"en": set("the of and to is are a in it that for by be with not this on as at from when which no yes only its can there after".split()), "fr": set("le la les des une est et à il elle ne pas que dans du au aux qui sur après avant oui non plus peut être de un l'entrepôt".split()), "es": set("el la los las una es y no se que de en un por con sí hay del al cuando lo como más su sus pertenece".split()), "de": set("der die das und ist nicht es wird nach ein eine den dem zu mit von gibt darf nur ja nein wenn auf zur zum ohne".split()), "it": set("il lo gli una è e di che non si per con sono nel della dopo quando sì più può essere".split()), "pt": set("o os as uma é e não se que de em um por com sim há do da ao quando mais seu após".split())}


def plain(s: str) -> str:
    """Letters and digits only, in one width and case."""
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if c.isalnum())


def unit_list(s: str) -> list[str]:
    """Units of a text; a stop inside an abbreviation or number is no sentence end, list marks are dropped."""
    t = _BULLETS.sub("", unicodedata.normalize("NFKC", s).strip()).lower()
    return _UNIT.findall(t)


def masked(question: str, answer: str) -> list[str]:
    """Units of the answer with an `E` before each run that the question has too (three units or more), numbers as `0`; collapse() drops the runs."""
    q, a = unit_list(question), unit_list(answer)
    known = {tuple(q[i : i + 3]) for i in range(len(q) - 2) if all(x.isalnum() for x in q[i : i + 3])}
    cover = bytearray(len(a))
    for i in range(len(a) - 2):
        if tuple(a[i : i + 3]) in known:
            cover[i] = cover[i + 1] = cover[i + 2] = 1
    out: list[str] = []
    for i, (x, c) in enumerate(zip(a, cover)):
        if c and not (i and cover[i - 1]):
            out.append("E")
        out.append(TAKEN + x if c else "0" if x[0].isdigit() else x)
    return out


TAKEN = "\x02"  # marks units of a run


def collapse(units: list[str]) -> list[str]:
    return [x for x in units if x[0] != TAKEN]


def shown(units: list[str]) -> list[str]:
    """Units with the runs written out: where a run is cut short shows in its last units only."""
    return ["0" if x[1:2].isdigit() and x[0] == TAKEN else x.lstrip(TAKEN) for x in units if x != "E"]


def bracketed(answer: str) -> bool:
    """Whether the text ends with a closing bracket or quote that was opened, as lists of identifiers do."""
    t = answer.rstrip()
    pair = {")": "(", "）": "（", "]": "[", "】": "【", "”": "“", "』": "『", "」": "「", "}": "{"}.get(t[-1:], "")
    return bool(pair) and t.count(pair) == t.count(t[-1]) > 0


def script(s: str) -> str:
    """Language of a text as far as its letters tell: zh, ja, ko, ru, th, ar, a Latin language of WORDS, or '' for none."""
    t = _IDENTIFIER.sub(" ", s)
    n = {"han": 0, "kana": 0, "hangul": 0, "cyr": 0, "thai": 0, "arab": 0}
    for c in t:
        o = ord(c)
        if 0x3400 <= o <= 0x9FFF:
            n["han"] += 1
        elif 0x3040 <= o <= 0x30FF:
            n["kana"] += 1
        elif 0xAC00 <= o <= 0xD7AF:
            n["hangul"] += 1
        elif 0x400 <= o <= 0x4FF:
            n["cyr"] += 1
        elif 0xE00 <= o <= 0xE7F:
            n["thai"] += 1
        elif 0x600 <= o <= 0x6FF:
            n["arab"] += 1
    words = _LATIN.findall(t.lower())
    wide = sum(n.values())
    if n["kana"] and n["kana"] * 6 >= wide:
        return "ja"
    for k, lang in (("hangul", "ko"), ("cyr", "ru"), ("thai", "th"), ("arab", "ar")):
        if n[k] * 2 > wide and n[k] >= len(words):
            return lang
    if n["han"] and n["han"] >= len(words):
        return "zh"
    if not words:
        return "zh" if n["han"] else ""
    all_words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", t.lower())
    hits = {k: sum(w in v for w in all_words) for k, v in WORDS.items()}
    best = max(hits, key=lambda k: (hits[k], k == "en"))
    return best if hits[best] >= 1 and (best == "en" or hits[best] > hits["en"]) else "en" if len(words) >= 2 else ""


def is_empty(answer: str | None) -> bool:
    p = plain(answer or "")
    return not p or p in STAND_INS


def is_copy(question: str | None, answer: str) -> bool:
    q, a = plain(question or ""), plain(answer)
    if len(q) < 4 or q not in a:
        return False
    return a.replace(q, "") in LEAD_INS | {""}


def other_language(question: str | None, answer: str) -> bool:
    if not question:
        return False
    q, a = script(question), script(answer)
    if not a or not q or a == q:
        return False
    if {a, q} <= {"zh", "en"}:  # a few words or names of the other language don't make an answer
        han, words = len(re.findall(f"[{_HAN}]", answer)), len(_LATIN.findall(_IDENTIFIER.sub(" ", answer)))
        return words >= 3 if a == "en" else han >= 3
    return True


def _h(units: list[str]) -> int:
    return int.from_bytes(blake2b("\x1f".join(units).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def sentences(units: list[str]) -> tuple[list[list[str]], list[str]]:
    """Finished sentences and the unfinished rest."""
    out, now = [], []
    for i, x in enumerate(units):
        if x in _STOP or x == "." and (i + 1 == len(units) or units[i + 1] not in ("0",)):
            if now:
                out.append(now)
            now = []
        else:
            now.append(x)
    return out, now


def tail(sentence: list[str], n: int) -> int:
    return _h(["^"] * max(0, n - len(sentence)) + sentence[-n:] if n else [])


def opening(units: list[str]) -> str:
    """Clauses of the masked units' beginning, at most OPENING_UNITS words and the rest of the clause they end in."""
    out: list[str] = []
    now: list[str] = []
    n = 0
    for x in units:
        if x in _STOP or x in _PAUSE or x == ".":
            if now:
                out.append(" ".join(now))
                now = []
            if n >= OPENING_UNITS:
                break
        elif any(c.isalnum() for c in x):
            now.append(x)
            n += 1
    return CLAUSE.join([*out, " ".join(now)] if now else out)


def template(collapsed: list[str], last: list[str]) -> int:
    """Key of what an answer begins with: the masked units, at most SHORT, and the last units written out, so a run cut short is another key."""
    return _h([*collapsed, "\x03", *last])


def stands(units: list[str]) -> Iterator[tuple[int, bool]]:
    """(template, whether a stop or the answer's end follows) of each beginning of an answer, given its masked units."""
    collapsed: list[str] = []
    last: list[str] = []
    for i, x in enumerate(units):
        if x[0] != TAKEN:
            collapsed.append(x)
            if len(collapsed) > SHORT:
                return
        if x != "E":
            last = [*last, *shown([x])][-3:]
            rest = units[i + 1 : i + 3]
            yield template(collapsed, last), not rest or rest[0] in _STOP or rest[0] == "." and rest[1:] != ["0"]


def prompt_grams(q: list[str]) -> list[int]:
    """Pairs of neighbouring words or ideographs of a prompt, hashed."""
    w = [x for x in q if x.isalnum()]
    return list({crc32(f"{x} {y}".encode("utf-8", "surrogatepass")) - (1 << 31) for x, y in zip(w, w[1:])})


SEP = "\x1f"
FEATURES = "pair_table string, row_id string, question_key bigint, simple string, opening string, grams array<int>, units string, whole bigint, short boolean, t3 bigint, t2 bigint"


def pairs(qa: DataFrame, results: DataFrame) -> DataFrame:
    """(pair_table, row_id, question, answer): both tables' pairs once each."""
    q = qa.groupBy(F.col("id").alias("row_id")).agg(F.max(F.struct("ground_truth", "question")).alias("v")).select("row_id", F.col("v.question").alias("question"), F.col("v.ground_truth").alias("answer"))
    r = results.where("available is null or available").groupBy("result_id").agg(F.max(F.struct("answer", "qa_id")).alias("v")).select(F.col("result_id").cast("string").alias("row_id"), F.col("v.qa_id").alias("qa_id"), F.col("v.answer").alias("answer"))
    known = q.select(F.col("row_id").alias("qa_id"), "question")
    r = r.join(known, "qa_id", "left").select("row_id", "question", "answer")
    return q.withColumn("pair_table", F.lit("qa_dataset")).unionByName(r.withColumn("pair_table", F.lit("condition_result"))).where("row_id is not null").select("pair_table", "row_id", "question", "answer")


def features(p: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for q, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                simple = "empty" if is_empty(a) else "copied" if is_copy(q, a) else ""
                whole = masked(q or "", a or "")
                u = [] if simple else whole
                words = u
                if not simple:
                    if other_language(q, a):
                        simple = "other_language"
                    if _IDENTIFIER.search(a):
                        words = masked(q or "", _IDENTIFIER.sub(" 0 ", a))
                rest = [] if not u or bracketed(a) else sentences(shown(u))[1]
                if simple:
                    rest = []
                last = shown(u)[-3:]
                u = collapse(u)
                begins = opening(collapse(words))
                grams = prompt_grams(unit_list(q or "")) if begins and not simple else []
                row = (_h([plain(q or "")]), simple, begins, grams, SEP.join(whole), template(u, last), len(u) <= SHORT, tail(rest, 3) if rest else None, tail(rest, 2) if rest else None)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[f.split()[0] for f in FEATURES.split(", ")])

    return p.mapInArrow(run, FEATURES)


def ending_counts(f: DataFrame) -> DataFrame:
    """(h, ends, mids): how often each run of two or three units ends a sentence and how often it stands inside one, over all answers; likewise how often each template is a whole answer or sentence and how often it goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, list[int]] = {}
            for joined in b.column(0).to_pylist():
                units = joined.split(SEP) if joined else []
                for h, ended in stands(units):
                    seen.setdefault(h, [0, 0])[0 if ended else 1] += 1
                done, rest = sentences(shown(units))
                for s, ended in [*((x, True) for x in done), (rest, False)]:
                    for n in (2, 3):
                        padded = ["^"] * (n - 1) + s
                        last = len(s) - 1
                        for k in range(len(s)):
                            if k == last and not ended:
                                break
                            c = seen.setdefault(_h(padded[k : k + n]), [0, 0])
                            c[0 if k == last else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["h", "ends", "mids"])

    return f.select("units").mapInArrow(run, "h bigint, ends bigint, mids bigint").groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("mids").alias("mids"))


def shingle_hashes(text: str) -> np.ndarray:
    u = text.split(" ")
    return np.unique(np.array([_h(u[i : i + SHINGLE]) & 0x7FFFFFFF for i in range(max(1, len(u) - SHINGLE + 1))], np.uint64))


_SEEDS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands(text: str) -> list[int]:
    """Buckets of an opening.  Each seed orders the shingles anew (sums and products that stay below a modulus would keep one order), so texts of similarity 0.8 share none once in 100,000."""
    sig = _mixed(shingle_hashes(text)[:, None] ^ _SEEDS).min(axis=0)
    return [_h([str(i), *map(str, sig[i * ROWS : (i + 1) * ROWS])]) for i in range(BANDS)]


def similar(a: str, b: str) -> bool:
    x, y = shingle_hashes(a), shingle_hashes(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def twin_keys(text: str) -> list[dict[str, int]]:
    """Keys that two openings have in common just if they are similar, with the side of each.

    Openings of n and m shingles reach SIMILARITY with some least number of shingles in common; each leaves out what it
    has above that in all ways (two of ten at most).  All of a key's openings of n shingles are similar to all of m."""
    h = _mixed(shingle_hashes(text))
    n = len(h)
    out = []
    for m in range(1, int(n / SIMILARITY + 1e-9) + 1):
        big, small = max(n, m), min(n, m)
        both = math.ceil(SIMILARITY * (n + m) / (1 + SIMILARITY) - 1e-9)
        if both <= small:
            size = _mixed(np.array([big << 32 | small], np.uint64))[0]
            keys = {int(h[list(keep)].sum(dtype=np.uint64) ^ size) for keep in combinations(range(n), both)}
            out += [{"twin": k - (1 << 64) if k >> 63 else k, "side": (n > m) - (n < m)} for k in keys]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each value spread over 64 bits, so that sums tell sets apart."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster): distinct openings that share a bucket of any band, linked wherever they are similar, labels spread until they stay.

    No bucket makes pairs of its members: the openings of a twin key are all similar to those of its other side, so a
    link from each to the least of that side connects them all."""
    band = F.pandas_udf(lambda s: pd.Series([bands(x) for x in s]), "array<bigint>")
    same = F.pandas_udf(lambda a, b: pd.Series([similar(x, y) for x, y in zip(a, b)]), "boolean")
    twin = F.pandas_udf(lambda s: pd.Series([twin_keys(x) for x in s]), "array<struct<twin:bigint,side:int>>")
    b = cut(openings.select("opening", F.explode(band("opening")).alias("band")))
    met = b.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    t = cut(b.join(met, "band").select("opening").distinct().select("opening", F.explode(twin("opening")).alias("k")).select("opening", "k.*"))
    hubs = t.groupBy("twin").agg(F.min(F.when(F.col("side") >= 0, F.col("opening"))).alias("big"), F.min(F.when(F.col("side") <= 0, F.col("opening"))).alias("small"), F.count(F.lit(1)).alias("n")).where("n > 1 and big is not null and small is not null").drop("n")
    links = t.join(hubs, "twin").select("opening", F.when(F.col("side") >= 0, F.col("small")).otherwise(F.col("big")).alias("hub")).where("opening != hub").distinct()
    links = cut(links.where(same("opening", "hub")))
    discard(t)
    both = links.unionByName(links.select(F.col("hub").alias("opening"), F.col("opening").alias("hub")))
    label = cut(openings.select("opening", F.col("opening").alias("cluster")))
    while True:
        near = both.join(label.select(F.col("opening").alias("hub"), F.col("cluster").alias("c")), "hub").groupBy("opening").agg(F.min("c").alias("c"))
        new = cut(label.join(near, "opening", "left").select("opening", F.least("cluster", F.coalesce("c", "cluster")).alias("cluster"), (F.col("c") < F.col("cluster")).alias("moved")))
        more = not new.where("moved").isEmpty()
        discard(label)
        label = new.drop("moved")
        if not more:
            discard(b)
            return label


def told(opening: Column) -> Column:
    """Five-unit shingles of an opening's clauses that hold no mark, once each."""
    units = F.split(opening, " ")
    runs = F.when(F.size(units) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.greatest(F.size(units) - SHINGLE + 1, F.lit(1))), lambda k: F.array_join(F.slice(units, k, F.lit(SHINGLE)), " "))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(runs), lambda x: ~x.rlike("(^| )[E0|]( |$)"))


def unrelated(asked: DataFrame, prompts: DataFrame) -> DataFrame:
    """(cluster) of the clusters that recur across LEAST_PROMPTS unrelated prompts.

    asked: cluster, question_key; prompts: question_key, grams, each once.  A prompt counts once in a cluster, however often it got the answer."""
    each = cut(asked.distinct())
    many = cut(each.groupBy("cluster").agg(F.count(F.lit(1)).alias("prompts")).where(F.col("prompts") >= LEAST_PROMPTS))
    grams = prompts.select("question_key", F.explode("grams").alias("gram"))
    base = grams.groupBy("gram").agg((F.count(F.lit(1)) / F.lit(float(max(1, prompts.count())))).alias("usual"))
    shared = each.join(many.select("cluster"), "cluster").join(prompts, "question_key").select("cluster", F.explode("grams").alias("gram")).groupBy("cluster", "gram").agg(F.count(F.lit(1)).alias("n"))
    most = shared.join(many, "cluster").join(base, "gram").groupBy("cluster").agg(F.max(F.col("n") / F.col("prompts") - F.col("usual")).alias("more"), F.max(F.col("n") / F.col("prompts")).alias("alike"))
    return many.join(most, "cluster", "left").where((F.coalesce("more", F.lit(0.0)) <= MORE + CHANCE / F.sqrt("prompts")) & (F.coalesce("alike", F.lit(0.0)) <= MOST_ALIKE)).select("cluster")


def refusal_templates(f: DataFrame) -> DataFrame:
    """Openings of refusals: those all of whose clauses recur across unrelated prompts, one at least with OWN_UNITS units of its own, then the openings with a shingle which LEAST_PROMPTS answers of those have and which is theirs mostly."""
    asked = f.where("simple = '' and opening != ''")
    per = cut(asked.groupBy("opening").agg(F.count(F.lit(1)).alias("n")))
    parts = cut(per.select("opening", F.explode(F.array_distinct(F.split("opening", r" \| "))).alias("clause")))
    long = F.size(F.split("clause", " ")) >= SHINGLE  # shorter ones are alike only if equal
    names = parts.select("clause").distinct()
    c = clusters(names.where(long).select(F.col("clause").alias("opening"))).withColumnRenamed("opening", "clause").unionByName(names.where(~long).withColumn("cluster", F.col("clause")))
    c = cut(c)
    prompts = cut(asked.groupBy("question_key").agg(F.first("grams").alias("grams")))
    met = cut(asked.select("opening", "question_key").distinct().join(parts, "opening").join(c, "clause").select("clause", "cluster", "question_key"))
    # a clause too rare to tell goes by its first units, if none of them is a mark
    rare = met.select("cluster", "question_key").distinct().groupBy("cluster").agg((F.count(F.lit(1)) < LEAST_PROMPTS).alias("rare"))
    first = F.slice(F.split("clause", " "), 1, SHINGLE)
    start = F.when((F.size(first) == SHINGLE) & ~F.array_contains(first, "E") & ~F.array_contains(first, "0"), F.concat(F.lit("^ "), F.array_join(first, " ")))
    c = cut(c.join(rare, "cluster").select("clause", F.when(F.col("rare"), start).otherwise(F.col("cluster")).alias("cluster")).where("cluster is not null"))
    met = met.select("clause", "question_key").join(c, "clause").select("cluster", "question_key")
    empty = c.join(unrelated(met, prompts), "cluster", "left_semi").select("clause", F.lit(1).alias("empty"))
    own = F.size(F.filter(F.split("clause", " "), lambda x: ~x.isin("E", "0"))) >= OWN_UNITS
    judged = parts.join(empty, "clause", "left").groupBy("opening").agg(F.min(F.coalesce("empty", F.lit(0))).alias("all"), F.max(own.cast("int")).alias("own"))
    sure = cut(judged.where("all = 1 and own = 1").select("opening"))
    each = per.join(sure.withColumn("sure", F.lit(1)), "opening", "left")
    sh = cut(each.select("opening", "n", F.coalesce("sure", F.lit(0)).alias("sure"), F.explode(told(F.col("opening"))).alias("shingle")))
    telling = sh.groupBy("shingle").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("sure")).alias("own")).where((F.col("own") >= LEAST_PROMPTS) & (F.col("own") >= MOSTLY * F.col("all")))
    foreign = f.where("simple = 'other_language' and opening != ''").select("opening").distinct().withColumn("shingle", F.explode(told(F.col("opening"))))  # refusals in the other language than the prompt's
    return sure.unionByName(sh.select("opening", "shingle").unionByName(foreign).join(telling, "shingle", "left_semi").select("opening")).distinct()


def _breaks_off(ends: Column, mids: Column) -> Column:
    return F.coalesce(ends / (ends + mids), F.lit(0.0)) < ENDS


def defects(qa: DataFrame, results: DataFrame) -> DataFrame:
    """pair_table, row_id, defect of each defective pair."""
    f = cut(features(pairs(qa, results)))
    refusals = refusal_templates(f).withColumn("refuses", F.lit(True))
    counts = cut(ending_counts(f))
    often = f.where("simple = '' and short and t3 is not null").groupBy("whole").agg(F.count_distinct("question_key").alias("prompts")).where(F.col("prompts") >= RECURS)
    recurring = often.join(counts.withColumnRenamed("h", "whole"), "whole").where(~_breaks_off(F.col("ends"), F.col("mids"))).select("whole", F.lit(True).alias("recurs"))
    c3 = counts.select(F.col("h").alias("t3"), F.col("ends").alias("e3"), F.col("mids").alias("m3"))
    c2 = counts.select(F.col("h").alias("t2"), F.col("ends").alias("e2"), F.col("mids").alias("m2"))
    j = f.drop("grams", "units", "question_key").join(refusals, "opening", "left").join(recurring, "whole", "left")
    loose = j.where("t3 is not null").join(c3, "t3", "left").join(c2, "t2", "left")
    n3, n2 = F.coalesce(F.col("e3") + F.col("m3"), F.lit(0)), F.coalesce(F.col("e2") + F.col("m2"), F.lit(0))
    off = F.when(n3 >= 3, _breaks_off(F.col("e3"), F.col("m3"))).when(n2 >= 3, _breaks_off(F.col("e2"), F.col("m2"))).otherwise(True) & F.col("recurs").isNull()
    loose = loose.withColumn("off", off).select(*j.columns, "off")
    done = j.where("t3 is null").withColumn("off", F.lit(False))
    defect = F.when(F.col("simple").isin("empty", "copied"), F.col("simple")).when(F.col("refuses"), "refusal").when(F.col("simple") != "", F.col("simple")).when(F.col("off"), "truncated")
    return loose.unionByName(done).withColumn("defect", defect).where("defect is not null").select("pair_table", "row_id", "defect")
