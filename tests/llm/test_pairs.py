import itertools
import random
from datetime import datetime as D

import pytest

from ontoloom.llm import pairs as pr


@pytest.mark.parametrize("a", [None, "", "  ", "？", "N/A", "null", "（无回答）", "<empty>", "[]", "……", "​"])
def test_empty(a):
    assert pr.is_empty(a)


@pytest.mark.parametrize("a", ["否", "No", "没有可达路径", "0", "是。"])
def test_short_is_not_empty(a):
    assert not pr.is_empty(a)


def test_copy():
    q = "甲仓的订单属于订单吗？"
    for a in (q, " 甲仓的订单属于订单吗?\n", f"您问的是：{q}", f"“{q}”。", q + q, q.upper()):
        assert pr.is_copy(q, a)
    for a in (f"关于“{q}”：是。", "是", q + "不属于。"):
        assert not pr.is_copy(q, a)
    assert not pr.is_copy(None, "x") and not pr.is_copy("", "x")


@pytest.mark.parametrize("q, a, want", [("订单有哪些关系？", "ownsOrder、viewsGoods、placesOrder（→标签）", False), ("订单有哪些关系？", "There are 6 states: waiting and done.", True), ("订单有哪些关系？", "経路は8つあります。", True), ("Which relations exist?", "路径共4跳，中间经过仓库。", True), ("Which relations exist?", "Le champ accepte au plus 40 caractères.", True), ("Which relations exist?", "Yes, by the subClassOf axiom.", False), ("Which relations exist?", "78시간이 지나면 취소됩니다.", True), ("订单？", "Всего 6 связей.", True), ("订单？", "42", False), ("订单？", "SUM(order_id)", False), (None, "any words here", False)])
def test_language(q, a, want):
    assert pr.other_language(q, a) == want


def refusing(n=400, share=0.1, seed=7):
    """Questions of five kinds with sound answers, some with a tail that any answer may have, and refusals in invented words: no phrase of declining is known to the code."""
    r = random.Random(seed)
    kinds = [("{}的状态有哪些取值？", "取值包括{}待处理和已完成"), ("{}属于{}吗？", "是，{}是{}的子类"), ("谁有权删除{}？", "管理员需要先提交申请才可删除{}"), ("{}超时后系统怎么处理？", "系统会自动关闭{}并通知主管"), ("如果去掉{}会影响什么？", "{}会失去全部继承关系")]
    tails = ["。相关负责部门为财务组", "。历史数据按日口径保留", ""]
    heads, cores, ends = ["啊呀，", "诸位见谅，", ""], ["此题小生答它不出来", "这般言语恕难从命照办", "蓝月亮底下没有这等事"], ["。另寻高明去罢", "", "。且去问问别家"]
    rows, bad = [], set()
    for i in range(n):
        name = "".join(r.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥") for _ in range(4)) + r.choice(["仓订单", "库钱包", "店货架", "区标签", "港运单", "柜批次", "行报价", "架库存"])
        q, a = r.choice(kinds)
        q, a = (x.replace("{}", name) for x in (q, a))
        if r.random() < share:
            a = r.choice(heads) + r.choice(cores) + r.choice(ends)
            bad.add(f"q{i}")
        else:
            a += r.choice(tails)
        rows.append((f"q{i}", q, r.choice("abcd"), a + "。", D(2024, 1, 1)))
    return rows, bad


def test_refusals_without_any_phrase(spark):
    rows, bad = refusing()
    q = spark.createDataFrame(rows, "id string, question string, category string, ground_truth string, created_at timestamp_ntz")
    got = {x.row_id for x in pr.defects(q, corpus(spark)[1].limit(0)).where("defect = 'refusal'").collect()}
    assert len(got & bad) >= 0.95 * len(bad) and len(got - bad) <= 0.05 * len(got)


def test_lcs_of_openings():
    a = "我 没 有 足 够 的 信 息 来 作 答"
    assert pr.similar(a, a) and not pr.similar(a, "系 统 会 自 动 关 闭 E")
    assert set(pr.bands(a)) == set(pr.bands(a)) and len(pr.bands(a)) == pr.BANDS


def test_clusters_against_all_pairs(spark):
    """Openings of random words, each with some changed at the ends or in one place: a bucket's least member is often foreign or similar to some only."""
    r = random.Random(3)
    texts = {"a b c d e", "z", "z z", "q q q q q q q", "q q q q q q"}
    for _ in range(60):
        u = [r.choice("abcdefghij") + r.choice("xyz") for _ in range(14)]
        for _ in range(12):
            v = list(u)
            for _ in range(r.randint(0, 3)):
                v[r.choice([0, 1, 12, 13, r.randrange(14)])] = r.choice("klmn")
            texts.add(" ".join(v[: r.randint(8, 14)]))
    texts = sorted(texts)
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(texts, 2):
        keys = {(k["twin"], k["side"]) for k in pr.twin_keys(x)}, {(k["twin"], -k["side"]) for k in pr.twin_keys(y)}
        assert pr.similar(x, y) == bool(keys[0] & keys[1])
        if pr.similar(x, y):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    got = {c.opening: c.cluster for c in pr.clusters(spark.createDataFrame([(x,) for x in texts], "opening string")).collect()}
    assert got == {x: find(x) for x in texts}


def corpus(spark):
    cats = ["a", "b", "c", "d"]
    qa = [(f"q{i}", f"第{i}号甲仓冷链订单的状态有哪些取值？", cats[i % 4], f"取值包括待处理、处理中、已完成。第{i}号甲仓冷链订单初始为待处理。相关负责部门为财务组" + "。" * (i % 2)) for i in range(60)]
    bad = {"q1": ("", "empty"), "q2": (qa[2][1], "copied"), "q3": ("系统会自动处理第3号甲仓冷链订单，同时由于", "truncated"), "q4": ("The request closes by itself after all.", "other_language")}
    qa = [(i, q, c, bad.get(i, (a,))[0]) for i, q, c, a in qa]
    cr = [(100, "q7", "没有可达路径", True), (101, "q8", "没有可达路径", True), (102, "q9", "没有可达路径", True), (103, "q1", "x", False), (104, "gone", None, True), (105, "q6", "取值包括待处理、处理中、已完成", True), (105, "q6", "取值包括待处理、处理中、已完成", True)]
    q = spark.createDataFrame([(*x, D(2024, 1, 1)) for x in [*qa, qa[1]]], "id string, question string, category string, ground_truth string, created_at timestamp_ntz")
    r = spark.createDataFrame([(a, b, "sym", c, d, 7) for a, b, c, d in cr], "result_id bigint, qa_id string, condition_name string, answer string, available boolean, opening int")
    return q, r, bad


def test_defects(spark):
    q, r, bad = corpus(spark)
    got = [tuple(x) for x in pr.defects(q, r).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("qa_dataset", i, d) for i, (_, d) in bad.items()} | {("condition_result", "104", "empty")}


def test_no_rows(spark):
    q, r, _ = corpus(spark)
    assert pr.defects(q.limit(0), r.limit(0)).count() == 0


def test_long_answer(spark):
    q, r, _ = corpus(spark)
    long = spark.createDataFrame([("z", "问题？", "a", "很好。" * 20000, D(2024, 1, 1))], q.schema)
    assert ("qa_dataset", "z") not in {(x[0], x[1]) for x in pr.defects(q.unionByName(long), r).collect()}


def test_cut_templates_stay_truncated_however_many(spark):
    """A template cut off for several prompts is no recurrence: it goes on in most answers, or stops inside a name."""
    cut_at = {}
    qa = []
    for i in range(240):
        name = f"{'甲乙丙丁戊己庚辛壬癸'[i % 10]}{'子丑寅卯辰巳午未申酉戌亥'[i // 10 % 12]}仓冷链订单取消原因"
        answer = f"系统会自动关闭{name}，如果{name}仍未付款就不再保留。"
        if i % 60 < 2:  # 8 prompts
            cut_at[f"q{i}"] = answer = answer[: answer.index("，") + 3]
        elif i % 60 < 4:
            cut_at[f"q{i}"] = answer = answer[: answer.index("，") + 3 + 4]
        elif i % 60 < 6:
            answer = "没有可达路径"
        qa.append((f"q{i}", f"{name}到期后怎么处理？", "abcd"[i % 4], answer, D(2024, 1, 1)))
    q = spark.createDataFrame(qa, "id string, question string, category string, ground_truth string, created_at timestamp_ntz")
    r = corpus(spark)[1].limit(0)
    assert {(x.row_id, x.defect) for x in pr.defects(q, r).collect()} == {(i, "truncated") for i in cut_at}
