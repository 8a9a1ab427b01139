import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoloom.editing import Editor, Team, scenario
from ontoloom.functions import text as tx
from ontoloom.functions.formula import FormulaError, compile_formula
from ontoloom.operators import chunks, concepts, graph, linkage, mining, profile, querylog, reason
from ontoloom.operators import schema_ops as so


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc客户", max_size=12), st.text("abc客户", max_size=12))
def test_lcs(a, b):
    assert tx.lcs_length(a, b) == lcs(a, b)


def test_edit_ratio():
    assert round(tx.indel("kitten", "sitting"), 6) == 0.615385 and round(tx.indel("客户信息", "客户信息表"), 4) == 0.8889 and tx.indel("", "") == 1 and tx.indel("", "a") == 0


def test_similar_names_against_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choices("订单客户信息表库存商品", k=r.randrange(1, 12))) for _ in range(40)]
    names = {*base}
    for n in base:
        i = r.randrange(len(n) + 1)
        names |= {n[:i] + "新" + n[i:], n[:i] + n[i + 1 :]}
    names -= {""}
    got = {(x.a, x.b) for x in concepts.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and round(tx.indel(a, b), 6) >= 0.85}


def test_merge_similar(spark):
    rows = [("c1", "客户信息"), ("c2", "客户信息表"), ("c3", "订单"), ("c4", " 订单 "), ("c5", None), ("c6", "供应商")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, name string, component string, k int")
    assert {(r.id, r.component, r.n_links) for r in concepts.merge_similar(df).collect()} == {("c1", "c1", 1), ("c2", "c1", 1), ("c3", "c3", 0), ("c4", "c3", 0), ("c6", "c6", 0)}
    assert concepts.merge_similar(df.limit(0)).count() == 0


def test_windows_reassemble(spark):
    texts = ["x" * 800, "abc" * 900, "", None, "短"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = chunks.chunk(df, "window").orderBy("doc_id", "pos").collect()
    for i, t in enumerate(texts):
        parts = [r.chunk for r in rows if r.doc_id == i]
        assert (parts[0] + "".join(p[200:] for p in parts[1:]) if parts else "") == (t or "")
    with pytest.raises(ValueError):
        chunks.by_window(F.col("text"), 10, 10)


def test_formula(spark):
    df = spark.createDataFrame([(120000, "a"), (5, "a"), (5, None), (None, None)], "annual_spend int, customer_name string")
    f = "IF(annual_spend > 100000, 'VIP', IF(customer_name IS NOT NULL, 'person', 'company'))"
    assert [r[0] for r in df.select(compile_formula(f)).collect()] == ["VIP", "person", "company", "company"]
    assert df.select(compile_formula("(annual_spend + 1) * 2 - 4 / 2")).first()[0] == 240000
    for bad in ("IF(", "a ? b", "1 1", "IF(a, 1)"):
        with pytest.raises(FormulaError):
            compile_formula(bad)
    with pytest.raises(FormulaError):
        compile_formula("gone > 1", {"a": F.col("a")})


def test_cycles(spark):
    e = lambda rows: spark.createDataFrame(rows, "child string, parent string, confidence double")
    kept, gone = graph.remove_cycles(e([("B", "A", 0.9), ("C", "B", 0.8), ("A", "C", 0.5), ("D", "C", 0.1)]))
    assert [tuple(r)[:2] for r in gone.collect()] == [("A", "C")] and kept.count() == 3
    kept, gone = graph.remove_cycles(e([("A", "A", 0.9)]))
    assert gone.count() == 1 and kept.count() == 0
    # two cycles that share a node, and two parents
    kept, gone = graph.remove_cycles(e([("B", "A", 0.9), ("A", "B", 0.3), ("B", "C", 0.9), ("C", "B", None), ("X", "A", 0.1), ("X", "C", 0.1)]))
    assert {tuple(r)[:2] for r in gone.collect()} == {("A", "B"), ("C", "B")} and graph.on_cycles(kept).isEmpty()
    assert graph.remove_cycles(e([]))[0].count() == 0


def test_closure_levels_components(spark):
    e = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "B"), ("D", "C"), ("E", "D"), ("A", "F"), ("E", "E"), (None, "A")], "child string, parent string")
    c = {tuple(r) for r in graph.closure(e).collect()}
    assert ("E", "F", 4) in c and ("D", "A", 2) in c and len(c) == 14
    ring = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "child string, parent string")
    assert {tuple(r) for r in graph.closure(ring).collect()} == {("A", "B", 1), ("B", "C", 1), ("C", "A", 1), ("A", "C", 2), ("B", "A", 2), ("C", "B", 2)}
    dag = e.where("child is not null and child != parent")
    assert {r.id: r.level for r in graph.levels(dag).collect()} == {"F": 0, "A": 1, "B": 2, "C": 2, "D": 3, "E": 4}
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "id string")
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("e", "d"), ("g", "f"), ("f", "e")], "a string, b string")
    assert {r.id: r.component for r in graph.components(nodes, links).collect()} == dict(zip("abcdefg", "aaadddd"))


def test_votes(spark):
    t = [("a", "Customer")] * 5 + [("b", "Customer")] * 4 + [("b", "Doctor")] + [("c", "Customer")] * 2 + [("c", "Doctor")] * 3 + [("d", None)]
    got = {r.predicate: (r.winner, r.share, r.status) for r in so.vote(spark.createDataFrame(t, "predicate string, cls string")).collect()}
    assert got == {"a": ("Customer", 1.0, "auto"), "b": ("Customer", 0.8, "review"), "c": (None, 0.6, "skip"), "d": ("unknown", 1.0, "auto")}


def test_types(spark):
    df = spark.createDataFrame([(v,) for v in ("42", "3.14", "hello", "2024-01-01", "True", None)], "v string")
    assert [r[0] for r in df.select(so.infer_type(F.col("v"))).collect()] == ["int", "float", "string", "date", "bool", "unknown"]


def test_null_skew_sample(spark):
    df = spark.createDataFrame([(i, "N/A" if i < 95 else str(i), None if i < 31 else "x", None) for i in range(100)], "id int, a string, b string, c string")
    n = {r.column_name: (r.null_rate, r.triage) for r in profile.null_rates(df, ["a", "b", "c"]).collect()}
    assert n == {"a": (0.0, "normal"), "b": (0.31, "low_confidence"), "c": (1.0, "ignored")}
    s = {r.column_name: (r.modal_value, r.skewed) for r in profile.skew(df, ["a", "b", "c"]).collect()}
    assert s == {"a": ("N/A", True), "b": ("x", True)}
    assert profile.stratified_sample(df, "id", ["a", "b", "c"], 10, 5).count() == 10
    assert profile.skew(df.limit(0), ["a"]).count() == 0


def test_linkage(spark):
    e = spark.createDataFrame([("crm", "1", "phone", "9"), ("erp", "x", "phone", "9"), ("crm", "2", "phone", "7"), ("erp", "y", "phone", ""), ("crm", "3", "phone", "5"), ("crm", "4", "phone", "5")], "system string, id string, bridge_type string, value string")
    m = linkage.mapping(e)
    assert [(r.members, r.confidence) for r in m.collect()] == [("crm=1|erp=x", 0.98)]
    assert {(r.system, r.coverage) for r in linkage.coverage(e, m).collect()} == {("crm", 0.25), ("erp", 0.5)}
    assert linkage.unmapped(e, m).count() == 4 and linkage.buckets(m).first().bucket == "high"


def test_mining(spark):
    docs = spark.createDataFrame([(1, "如果客户在24小时内未支付，系统将自动取消。支付完成后，系统会自动更新库存数量。VIP客户是一种客户。"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.event_type for r in mining.triggers(docs).collect()} == {"time_based", "status_transition"}
    assert [(r.child, r.parent) for r in mining.hearst(docs).collect()] == [("VIP客户", "客户")]
    for f in (mining.triggers, mining.hearst, mining.phrases, mining.operations, mining.flows, mining.derivations, mining.limits):
        assert f(docs.limit(0)).count() == 0


def test_query_log(spark):
    log = spark.createDataFrame([(1, "SELECT SUM(total), COUNT(*) FROM `orders` WHERE city = ? GROUP BY city", 5), (2, "update orders set a = 1 where city is null", None), (3, None, 1)], "log_id bigint, sql string, frequency bigint")
    assert {(r.table_name, r.verb, r.weight) for r in querylog.crud(log).collect()} == {("orders", "select", 5), ("orders", "update", 1)}
    assert {(r.function, r.column_name, r.group_by) for r in querylog.aggregates(log).collect()} == {("sum", "total", "city")}
    assert [r.column_name for r in querylog.index_candidates(log).collect()] == ["city"]


def test_nearest_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8))
    v[7] = 0
    v[9] = v[8]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id bigint, embedding array<float>")
    v = v.astype(np.float32).astype(float)
    n = np.linalg.norm(v, axis=1)
    s = np.round(np.divide(v @ v.T, n[:, None] * n[None], out=np.zeros((60, 60)), where=(n[:, None] * n[None]) > 0), 9)
    want = {(q, i) for q in range(0, 60, 10) for i in sorted((i for i in range(60) if i != q), key=lambda i: (-s[q, i], i))[:5]}
    assert {(x.query_id, x.vec_id) for x in concepts.nearest(df, df.where("vec_id % 10 = 0"), 5).collect()} == want


def test_reason(spark):
    q = spark.createDataFrame([("e1", "purchase done"), ("e2", "zz")], "event string, text string")
    assert [tuple(r) for r in reason.fire(q, spark.createDataFrame([("t", "PURCHASE")], "name string, text string"), 2).collect()] == [("e1", "t")]
    m = reason.mentions(spark.createDataFrame([(1, "智能手机和手机"), (2, None), (3, "无")], "question_id int, question string"), spark.createDataFrame([("手机",), ("智能手机",), (None,)], "name string"))
    assert [tuple(r) for r in m.collect()] == [(1, "智能手机")]


def editor(spark):
    return Editor(spark, {"concepts": spark.createDataFrame([("客户", "客户"), ("订单", "订单")], "id string, name string"), "properties": spark.createDataFrame([("p1", "客户")], "id string, domain string"), "relations": spark.createDataFrame([("r1", "places", "客户", "订单")], "id string, name string, domain string, range string"), "axioms": spark.createDataFrame([], "id string, axiom_type string, subject string, object string, confidence double")})


def test_editor(spark):
    e = editor(spark)
    e.create("concepts", id="商品", name="商品")
    e.update("concepts", "商品", name="货")
    assert e.read("concepts", "商品").first().name == "货"
    with pytest.raises(ValueError):
        e.create("relations", id="r2", name="x", domain="客户", range="none")
    e.delete("concepts", "客户")
    assert e.tables["relations"].count() == 0 and e.tables["properties"].count() == 0 and e.tables["concepts"].count() == 2
    assert {(r.op, r.n) for r in e.summary().collect()} == {("create", 1), ("update", 1), ("delete", 1)}


def test_team(spark):
    t = Team(editor(spark))
    a = t.add("reasoner", "reasoner")
    with pytest.raises(ValueError):
        a.use("delete", "concepts", "客户")
    with pytest.raises(ValueError):
        t.add("reasoner", "curator")
    t.send("x", "reasoner", "hi")
    t.send("reasoner", "broadcast", "all")
    assert [r.text for r in t.inbox("reasoner").collect()] == ["hi"]


def test_scenario(spark):
    e = editor(spark)
    r = scenario(e, [{"id": "VIP客户", "name": "VIP客户"}], [("VIP客户", "客户")], [{"id": "r9", "name": "owns", "domain": "订单", "range": "客户"}], [("VIP客户", "places", True), ("订单", "places", False)], [("客户", "订单"), ("订单", "VIP客户")], [("VIP客户", "客户", True), ("客户", "VIP客户", False)], [("e", "x")]).collect()
    assert [x.ok for x in r] == [True] * 7 and r[4].detail == "1 of 2 reachable"
    bad = scenario(e, [], [], [{"id": "r", "name": "n", "domain": "gone", "range": "客户"}], [("客户", "owns", True)], [("a", "b")], [], []).collect()
    assert [x.ok for x in bad][2:4] == [False, False]


def test_streaming(spark, tmp_path):
    from ontoloom.streaming import eca

    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'purchase' event_type union all select timestamp'2024-01-01 00:20:00', 'purchase' union all select timestamp'2024-01-01 00:20:00', 'view'")
    rows.write.parquet(str(tmp_path / "in"))
    t = spark.createDataFrame([("buy", "purchase completed")], "name string, text string")
    out = eca.fired(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), t)
    q = out.writeStream.outputMode("complete").format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.trigger, r.n) for r in spark.table("fired").collect()] == [("purchase", "buy", 2)]


def test_complete_comments(spark):
    cols = spark.createDataFrame([("t", "a", "given"), ("t", "b", ""), ("t", "c", None), ("t", "d", None), ("t", "e", None)], "table_name string, column_name string, comment string")
    guess = spark.createDataFrame([("t", "b", "客户编号"), ("t", "c", "金额"), ("t", "d", "备注")], "table_name string, column_name string, comment string")
    known = spark.createDataFrame([("b", "客户编号"), ("c", "城市名称")], "column_name string, comment string")
    got = {r.column_name: (r.comment, r.confidence) for r in mining.complete_comments(cols, guess, known).collect()}
    assert got == {"a": ("given", 1.0), "b": ("客户编号", 0.9), "c": ("金额", 0.3), "d": ("备注", 0.6), "e": ("", 0.0)}


def test_substrings_are_those_that_names_may_be(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab订单客户𝕏") for _ in range(n))
    names = sorted({word(r.randrange(1, 61)) for _ in range(300)} | {word(2) for _ in range(20)})
    texts = {i: "".join(r.choice([word(r.randrange(1, 9)), r.choice(names).upper()]) for _ in range(r.randrange(0, 9))) for i in range(60)}
    rows = spark.createDataFrame([*texts.items(), (99, None)], "id int, text string")
    got = tx.substrings(rows, "text", spark.createDataFrame([(n,) for n in [*names, ""]], "k string")).collect()
    pairs = [(x.id, x.k) for x in got]
    want = {(i, n) for i, t in texts.items() for n in names if n in t.lower()}
    assert len(pairs) == len(set(pairs)) and want <= set(pairs) and all(x.text == texts[x.id] and x.k in x.text.lower() for x in got)
    every = sum(len({t.lower()[i : i + n] for i in range(len(t) - n + 1)}) for t in texts.values() for n in {len(n) for n in names})
    assert len(pairs) - len(want) < every / 50  # not all substrings of the lengths that names have
    assert tx.substrings(rows, "text", spark.createDataFrame([], "k string")).count() == 0
    assert tx.substrings(rows.limit(0), "text", rows.select(F.col("text").alias("k"))).count() == 0


def counted(spark, rows, schema):
    """A table and the accumulator of how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), made


def test_mentions_make_the_names_once(spark):
    names, made = counted(spark, [("手机",), ("智能手机",), ("x" * 60,)], "name string")
    q = spark.createDataFrame([(1, "智能手机和手机"), (2, "X" * 70), (3, None)], "question_id int, question string")
    assert {tuple(r) for r in reason.mentions(q, names).collect()} == {(1, "智能手机"), (2, "x" * 60)}
    assert made.value == 3


def test_bindings_make_the_names_once(spark):
    names, made = counted(spark, [("订单",), ("VIP客户",), ("vip客户",), ("单",)], "name string")
    rules = spark.createDataFrame([(1, "如果VIP客户且订单>3，就打折"), (2, None), (3, "订单单号")], "rule_id int, text string")
    assert {tuple(r) for r in so.bind(so.split_rule(rules), names).collect()} == {(1, 0, "VIP客户"), (1, 1, "订单"), (3, 0, "订单")}
    assert made.value == 4


def test_pairs_of_similar_names_stay_in_their_task(spark):
    """A clique of n names makes n - 1 links for their class and a count for each, not a row for each pair."""
    names = ["订单编号甲乙丙丁戊己庚辛" + c for c in "天地玄黄宇宙洪荒日月盈昃辰宿列张"] + ["wholly_different"]
    t = concepts.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), 0.85, summed=True).collect()
    assert sum(x.b is not None for x in t) == 15 and len(t) == 31
    assert {x.a: x.n for x in t if x.b is None} == {n: 15 for n in names[:-1]}


def test_texts_of_great_cosine_against_all_pairs(spark):
    r = random.Random(5)
    words = ["订单", "客户", "华东", "发票", "日", "月", "审核", "记录", "abc_", "order_"]
    texts = sorted({"".join(r.choice(words) for _ in range(r.randrange(1, 7))) for _ in range(150)} | {"啊", "", "a" * 90, "a" * 95})
    df = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(texts)], "id string, text string")
    v: dict = {}
    for x in concepts.hash_embed(df, None).collect():
        v.setdefault(x.id, {})[x.bucket] = x.weight
    cos = {(a, b): round(sum(w * v[b].get(g, 0) for g, w in v[a].items()), 4) for a in v for b in v if a < b}
    for least in (0.75, 0.85):
        want = {p: c for p, c in cos.items() if c >= least}
        got = concepts.cosine_texts(df, least).collect()
        assert len(got) == len(want) and all(abs(want[x.a, x.b] - x.cosine) < 2e-4 for x in got)
        few = concepts.cosine_texts(df, least, summed=True).count()
        assert 0 < few < len(want)
