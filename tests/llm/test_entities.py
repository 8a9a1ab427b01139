import itertools
import math
import random
from datetime import datetime as D

from ontoloom.llm import entities as en

SCOPE = [("north", "华北"), ("south", "南方"), ("online", "线上"), ("rental", "租赁"), ("bonded", "保税")]
PERIOD = [("weekly", "每周"), ("monthly", "每月"), ("yearly", "全年")]
KIND = [("tea", "茶叶"), ("toy", "玩具"), ("books", "图书"), ("shoes", "鞋靴")]
OBJECT = [("order", "订单"), ("wallet", "钱包"), ("coupon", "优惠"), ("shelf", "货架")]
MATTER = [("cost_calc", "成本核算"), ("risk_grade", "风险等级"), ("sync_task", "同步任务")]


def corpus(seed=0, n=220):
    r = random.Random(seed)
    things = r.sample(list(itertools.product(SCOPE, PERIOD, KIND, OBJECT, MATTER)), n)
    rows, truth, k = [], set(), 0
    for t in things:
        ids = {}
        for src in ("rdb", "text", "dialogue"):
            if r.random() < 0.75:
                k += 1
                zh = [x[1] for x in t]
                i = f"concept_{r.getrandbits(32):08x}"
                ids[src] = i
                if src == "rdb":
                    rows.append((i, "".join(zh) + "表", "_".join(x[0] for x in t), None, f"{zh[2]}数据，要{zh[1]}的", " RDB" if r.random() < 0.3 else "rdb", "table:" + "_".join(x[0] for x in t[2:]), D(2024, 1, 1)))
                elif src == "text":
                    rows.append((i, f"{zh[3]}{zh[4]}（{zh[0]}、{zh[1]}、{zh[2]}）", None, [], "待补充", "text", None, D(2024, 1, 1)))
                else:
                    rows.append((i, zh[3] + zh[4], None, [zh[0] + zh[2]], f"要{zh[1]}的", "dialogue", "turn:1", D(2024, 1, 1)))
        truth |= {tuple(sorted(p)) for p in itertools.combinations(ids.values(), 2)}
    return rows, truth


SCHEMA = "id string, name string, name_en string, aliases array<string>, description string, source string, source_ref string, loaded_at timestamp_ntz, properties array<string>, identity_spec string, a string, theta double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, "clash", 0.0) for r in rows], SCHEMA)


def test_held_out_truth(spark):
    rows, truth = corpus()
    df = frame(spark, [*rows, rows[0], ("concept_x", None, None, None, None, "text", None, None), ("concept_y", "无", None, None, None, None, None, None)])
    got = {tuple(r) for r in en.found(df).collect()}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97
    assert all(a < b for a, b in got)


def test_layout_is_learned(spark):
    """Places of a code name are told by which neighbours go together, whatever their number."""
    made = en.learn_layout(en.latest(frame(spark, corpus()[0])))
    assert made == (2, 1, 1, 1, 1)
    r = random.Random(4)
    heads, tails = [("red", "fox"), ("blue", "jay"), ("grey", "owl"), ("brown", "bear")], ["day", "night", "noon"]
    rows = [(f"concept_{i}", "名", "_".join((*r.choice(heads), r.choice(tails), r.choice(["up", "down"]))), None, None, "rdb", None, D(2024, 1, 1)) for i in range(200)]
    assert en.learn_layout(en.latest(frame(spark, rows))) == (1, 1, 2)
    assert en.learn_layout(en.latest(frame(spark, [(*rows[0][:2], None, *rows[0][3:])]))) == ()


def test_empty(spark):
    assert en.found(frame(spark, corpus()[0][:1]).limit(0)).count() == 0


def marginals(pairs):
    """By enumeration of all one-to-one sets of pairs."""
    z, m = 0.0, dict.fromkeys(range(len(pairs)), 0.0)
    for pick in itertools.product([0, 1], repeat=len(pairs)):
        used = [(pairs[i][0], pairs[i][3]) for i, x in enumerate(pick) if x] + [(pairs[i][1], pairs[i][2]) for i, x in enumerate(pick) if x]
        if len(set(used)) == len(used):
            w = math.exp(sum(pairs[i][4] for i, x in enumerate(pick) if x))
            z += w
            for i, x in enumerate(pick):
                m[i] += w * x
    return [m[i] / z for i in m]


def test_propagation_is_exact_on_trees(spark):
    pairs = [("a1", "b1", "s", "t", 2.0), ("a1", "b2", "s", "t", 1.0), ("a2", "b2", "s", "t", 1.5), ("a3", "b9", "s", "t", 0.3), ("a1", "c1", "s", "u", 1.0)]
    got = {(r.a, r.b): r.confidence for r in en.propagate(spark.createDataFrame(pairs, "a string, b string, src_a string, src_b string, theta double")).collect()}
    for p, want in zip(pairs, marginals(pairs)):
        assert abs(got[p[0], p[1]] - want) < 0.01


def test_code_names():
    vocab = {"tea": 2, "order": 1, "cost_calc": 0, "north": 4, "weekly": 3}
    assert en.keys_in("DWD_NorthWeeklyTeaOrderCostCalc", vocab, 2) == {4: {"north"}, 3: {"weekly"}, 2: {"tea"}, 1: {"order"}, 0: {"cost_calc"}}
    assert en.code_parts("a_b_c_d_e_f", (2, 1, 1, 1, 1)) == [(0, "e_f"), (1, "d"), (2, "c"), (3, "b"), (4, "a")] and en.code_parts("", (2, 1)) == []


def test_rare_code_words_beside_a_hot_one(spark):
    places = [SCOPE, PERIOD, KIND, OBJECT, MATTER]
    codes = ["_".join(p[0][0] for p in places)] * 300
    codes += ["_".join((p[(i + k) % len(p)])[0] for k, p in enumerate(places)) for i in range(60)]
    codes += ["t" + "_".join([w[0], "weekly", "tea", "order", "cost_calc"]) for w in SCOPE[:3] for _ in range(6)]
    codes += ["_".join([w[0], "weekly", "tea", "order", "cost_calc"]) for w in SCOPE for _ in range(8)]
    rows = [(f"concept_{i}", "名", c, None, None, "rdb", None, D(2024, 1, 1)) for i, c in enumerate(codes)]
    assert en.vocabulary(en.latest(frame(spark, rows)), (2, 1, 1, 1, 1)) == {w[0]: 4 - k for k, p in enumerate(places) for w in p}


def test_rivals_are_told_by_their_fields(spark):
    """Of three records of a source with one tuple, one names the other source's fields; copies that nothing tells apart share their marginal."""
    rows, truth = corpus()
    full = [*(r for r in rows if r[5] != "dialogue")]
    near = [r for r in full if r[1].startswith("订单成本核算（") and r[5] == "text"][:1] or [r for r in full if r[5] == "text"][:1]
    i, name = near[0][0], near[0][1]
    pair = next(p for p in sorted(truth) if i in p and any(r[0] in p and r[5].strip().lower() == "rdb" for r in full))
    other = next(x for x in pair if x != i)
    fields = {i: ["order_no"], other: ["order_no", "paid_at"], "concept_r1": ["weight_kg"], "concept_r2": ["height_cm"]}
    full += [(k, name, *near[0][2:]) for k in ("concept_r1", "concept_r2")]
    df = spark.createDataFrame([(*r, fields.get(r[0]), None, "clash", 0.0) for r in full], SCHEMA)
    assert pair in {tuple(r) for r in en.found(df).collect()}


def test_classes_stand_for_their_records(spark):
    """Messages of classes equal those of their records written out."""
    schema = "a string, b string, src_a string, src_b string, theta double"
    each = [("a1", f"b{k}", "s", "t", 1.0) for k in range(4)] + [("a1", "b9", "s", "t", 3.0), ("a2", "b9", "s", "t", 0.5)]
    want = {(r.a, r.b): r.confidence for r in en.propagate(spark.createDataFrame(each, schema)).collect()}
    some = [(*each[0], 1, 4), (*each[4], 1, 1), (*each[5], 1, 1)]
    got = {(r.a, r.b): r.confidence for r in en.propagate(spark.createDataFrame(some, schema + ", n_a int, n_b int")).collect()}
    assert len(got) == 3 and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
