import random
import time

import numpy as np
import pytest

from ontoloom.llm import toxicity as tx


@pytest.mark.parametrize("a, b", [("你个智 障", "你个智障"), ("臭*不*要*脸", "臭不要脸"), ("早～说～了", "早说了"), ("b1tch", "bitch"), ("m.o.r.o.n.", "moron"), ("fuuuck", "fuck"), ("ＭＯＲＯＮ", "moron"), ("死​骗​子", "死骗子")])
def test_disguises(a, b):
    assert tx.bare(a).strip(".") == tx._RUN.sub(r"\1", b)


def brute(s):
    """Maximal segments by definition: the best segment, then those left and right of it."""
    best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, i, j = best
    return brute(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(s[j:])]


def test_segments_against_definition():
    r = random.Random(2)
    for _ in range(200):
        s = [r.choice([-3, -2, -1, 1, 2, 3]) + r.random() * 1e-3 for _ in range(r.randrange(1, 14))]
        assert [(a, b) for a, b, _ in tx.segments(np.array(s))] == brute(s)


def test_segments_take_linear_time():
    s = np.where(np.arange(400_000) % 4 == 0, 1.0, -2.0)  # isolated hits, each of which once walked down the whole stack
    t = time.perf_counter()
    assert len(tx.segments(s)) == 100_000
    assert time.perf_counter() - t < 1


def test_own_label_is_left_out():
    """A gram of two toxic texts weighs nothing in one of them, which leaves a single one."""
    m = tx.Model(3, 100, np.array([7]), np.array([2.0]), np.array([0.0]), np.array([0.001]))
    u = tx.units("白痴说说")
    m.keys = tx.grams(u, 2)[:1]
    assert m.hits(u)[0][0] == m.weights[0] > m.hits(u, True)[0][0] == 0 and m.hits(u, False)[0][0] == m.weights[0]


GOOD = ["物流很快，包装完整。", "请注意仓库的规则并不相同。", "白痴级教程，一看就会。", "Parcel arrived on time and looks fine.", "订单流程清楚，客服很耐心。"]
BAD = ["你们客服就是一群废物", "这白痴商家怎么不去死", "外地人天生就是贼", "you are a scumbag go to hell", "深夜裸聊先付后看"]


def corpus(n, seed):
    r = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        parts = [r.choice(GOOD) for _ in range(r.randrange(1, 12))]
        if r.random() < 0.2:
            parts.insert(r.randrange(len(parts) + 1), r.choice(BAD) + "。")
            truth.add(i)
        rows.append((i, "".join(parts), r.choice([" Review", "review", "re-view", None])))
    return rows, truth


def frames(spark, rows, labels):
    return spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id bigint, text string, source string, score double"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out(spark):
    rows, truth = corpus(1500, 1)
    r = random.Random(5)
    labels = [(i, int((i in truth) != (r.random() < 0.03))) for i in range(700)] + [(700, None), (701, 0), (701, 1)]
    docs, lab = frames(spark, [*rows, (9001, None, None), (9002, "", "x"), (9003, " \n", "x"), (9004, "好。" * 40000, "x")], labels)
    got = {x[0] for x in tx.found(docs, lab).collect()}
    held = {i for i in range(710, 1500)}
    tp = len(got & truth & held)
    assert tp / len(truth & held) > 0.95 and tp / len(got & held) > 0.95 and not got & {9001, 9002, 9003, 9004}
    s = tx.scored(docs, lab)
    shown = tx.passages(s, docs.where("doc_id < 9000")).where("toxic").select("passage").distinct().limit(200).collect()
    assert any(x.passage and "go to hel" in x.passage for x in shown) and any(x.passage and "外地人" in x.passage for x in shown)
    rate = {x.source: x for x in tx.rates(s).collect()}
    assert rate["review"].n_docs + rate["re_view"].n_docs + rate[None].n_docs == 1501 and rate["review"].n_toxic > 0


def test_without_labels_and_rows(spark):
    docs, lab = frames(spark, corpus(50, 3)[0], [(1, 0)])
    assert tx.scored(docs, lab.limit(0)).count() == 50
    assert tx.found(docs.limit(0), lab).count() == 0
