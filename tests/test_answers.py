import itertools
import json
import random
from datetime import datetime as D

from ontoloom import session
from ontoloom.editing import Editor, Team
from ontoloom.operators import concepts, graph, hierarchy, models, reason
from ontoloom.operators import schema_ops as so


def test_shortest_paths_against_search(spark):
    """Ways over own and inherited relations, against a search that goes through all of them."""
    r = random.Random(2)
    parent = {f"n{i}": f"n{r.randrange(i)}" if i and r.random() < 0.8 else None for i in range(14)}
    rel = {(f"r{r.randrange(4)}", f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(16)} | {("out", "x", "n1"), ("in", "n2", "x")}
    nodes = spark.createDataFrame([(c, p, D(2024, 1, 1)) for c, p in parent.items()], "concept_id string, parent_id string, updated_at timestamp_ntz")
    ask = [(a, b) for a, b in itertools.product([*list(parent)[:8], "x"], repeat=2) if a != b]

    def steps(c):
        up, x = {c}, c
        while parent.get(x):
            x = parent[x]
            up.add(x)
        return {(n, b) for n, a, b in rel if a in up}

    want = set()
    for a, b in ask:
        best, level = {a: ""}, {a: ""}
        for k in range(1, 5):
            new = {}
            for at, path in level.items():
                for n, to in steps(at):
                    way = f"{path}→{n}" if path else n
                    if to not in best and (to not in new or way < new[to]):
                        new[to] = way
            if b in new:
                want.add((a, b, k, new[b]))
                break
            best |= new
            level = new
    sets = session.cut(hierarchy.nested_sets(nodes))
    got = graph.shortest_paths(spark.createDataFrame(sorted(rel), "name string, domain string, range string"), spark.createDataFrame(ask, "src string, dst string"), sets)
    assert {tuple(x) for x in got.collect()} == want


def test_levels_of_forests_and_other_graphs(spark):
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 30)] + [("a", "b"), ("b", "a")]
    got = {x.id: x.level for x in graph.levels(spark.createDataFrame(chain, "child string, parent string")).collect()}
    assert got == {f"c{i}": i for i in range(30)}
    both = [("d", "b"), ("d", "c"), ("c", "b"), ("b", "a")]
    assert {x.id: x.level for x in graph.levels(spark.createDataFrame(both, "child string, parent string")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_attach_only_where_no_parent_is(spark):
    e = spark.createDataFrame([("a", "b")], "child string, parent string")
    m = spark.createDataFrame([("a", "z", 0.9), ("c", "y", 0.5), ("c", "x", 0.5), ("d", "d", 1.0), (None, "x", 1.0)], "child string, parent string, confidence double")
    assert [tuple(x) for x in graph.attach(e, m).collect()] == [("c", "x", 0.5)]


def test_cosine_links_against_all_pairs(spark):
    r = random.Random(4)
    words = ["".join(r.choices("甲乙丙丁戊", k=r.randrange(2, 7))) for _ in range(60)]
    v = session.cut(concepts.hash_embed(spark.createDataFrame([(f"i{k}", w) for k, w in enumerate(words)], "id string, text string"), None))
    vec = {}
    for x in v.collect():
        vec.setdefault(x.id, {})[x.bucket] = x.weight
    dot = lambda a, b: round(sum(w * vec[b].get(g, 0) for g, w in vec[a].items()), 4)
    want = {(a, b) for a in vec for b in vec if a < b and dot(a, b) >= 0.75}
    assert want and {(x.a, x.b) for x in concepts.cosine_links(v, 0.85, 0.75).collect()} == want


def test_judge_decides_the_middle_only(spark):
    links = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.76)], "a string, b string, cosine double")
    names = spark.createDataFrame([("a", "订单"), ("b", "订货单"), ("c", "定单")], "id string, name string")
    ask = lambda ps: ["Yes, they do" if "订单 / 定单" in p else "no" for p in ps]
    assert {(x.a, x.b): x.linked for x in models.judge(links, names, ask).collect()} == {("a", "b"): True, ("a", "c"): True, ("b", "c"): False}
    assert {(x.a, x.b): x.linked for x in models.judge(links, names).collect()} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}


def test_model_steps_keep_what_holds(spark):
    docs = spark.createDataFrame([(1, "客户提交订单"), (2, None), (3, "")], "doc_id bigint, text string")
    said = {"concepts": [{"name": "客户", "span": "客户", "confidence": 0.9}, {"name": "仓库", "span": "仓库"}, {"name": "", "span": "订单"}, "x"], "relations": [{"domain": "客户", "name": "提交", "range": "订单"}, {"domain": "客户", "name": "看", "range": "无此"}], "axioms": [{"axiom_type": "domain", "subject": "提交", "object": "客户", "confidence": 0.8}, {"axiom_type": "odd", "subject": "a", "object": "b", "confidence": 1}, {"axiom_type": "range", "subject": "提交", "object": "订单", "confidence": 0.5}], "services": [{"name": "下单", "composition_type": "odd", "steps": "a, b"}]}
    hook = lambda ps: ["```json\n" + json.dumps(said, ensure_ascii=False) + "\n```"] * len(ps)
    assert [(x.name, x.confidence, x.n_docs) for x in models.text_concepts(docs, hook).collect()] == [("客户", 0.9, 1)]
    refs = spark.createDataFrame([("客户", "c1"), ("订单", "c2")], "ref string, id string")
    assert [tuple(x) for x in models.text_triples(docs, refs, hook).collect()] == [("提交", "c1", "c2", 0.7)]
    rel = spark.createDataFrame([("提交", "c1", "c2")], "name string, domain string, range string")
    assert [tuple(x) for x in models.text_axioms(rel, hook).collect()] == [("domain", "提交", "客户", 0.8)]
    ops = spark.createDataFrame([("客户", "提交"), ("客户", "取消"), (None, "x")], "actor string, name string")
    assert [tuple(x) for x in models.compositions(ops, hook).collect()] == [("下单", "sequential", "a, b")]
    assert models.text_concepts(docs).count() == models.text_triples(docs, refs).count() == models.text_axioms(rel).count() == models.compositions(ops).count() == 0


def test_rules_are_generated_and_checked(spark):
    rules = spark.createDataFrame([(1, "如果客户下单，则客户下单，"), (2, "如果金额 > 10 且订单多则通知"), (3, "没有结论")], "rule_id int, text string")
    c = spark.createDataFrame([("c1", "客户"), ("c2", "金额"), ("c3", "订单")], "id string, name string")
    parts = session.cut(so.split_rule(rules))
    atoms = so.generate_rules(parts, so.bind(parts, c))
    assert {(x.rule_id, x.part, x.predicate) for x in atoms.collect()} == {(1, "body", "客户"), (1, "head", "客户"), (2, "body", "greaterThan"), (2, "body", "订单")}
    props = spark.createDataFrame([], "name string")
    assert {tuple(x) for x in so.validate_rules(atoms, rules.select("rule_id"), c.where("name != '订单'"), props).collect()} == {(2, "empty_head"), (2, "builtin:?y"), (2, "unknown:订单"), (3, "empty_body"), (3, "empty_head")}


def test_covering_and_dispatch(spark):
    assert {(x.lo, x.q) for x in hierarchy.covering(spark.createDataFrame([(0,), (5,), (9,)], "lo bigint"), spark.createDataFrame([("a", 0, 9), ("b", 5, 5)], "q string, qlo bigint, qhi bigint"), 4).collect()} == {(0, "a"), (5, "a"), (9, "a"), (5, "b")}
    sets = hierarchy.nested_sets(spark.createDataFrame([("a", None, D(2024, 1, 1)), ("b", "a", D(2024, 1, 1))], "concept_id string, parent_id string, updated_at timestamp_ntz"))
    q = spark.createDataFrame([("q1", "subclass"), ("q2", None), ("q3", "permission"), ("q4", "subclass")], "question_id string, category string")
    m = spark.createDataFrame([("q1", 1, "b"), ("q1", 2, "a"), ("q3", 1, "b"), ("q4", 1, "a"), ("q4", 2, "b")], "question_id string, rank int, id string")
    lists = {"relations": spark.createDataFrame([("b", "r1|r2")], "id string, answer string")}
    assert {tuple(x) for x in reason.dispatch(q, m, sets, lists).collect()} == {("q1", "is_a", "b", "是"), ("q2", "describe", None, None), ("q3", "relations", "b", "r1|r2"), ("q4", "is_a", "a", "否")}


def test_agents_read_what_is_inherited_and_edits_are_saved(spark, tmp_path):
    t = {"concepts": spark.createDataFrame([("a", "甲"), ("b", "乙")], "id string, name string"), "properties": spark.createDataFrame([("p1", "a", "价")], "id string, domain string, name string"), "relations": spark.createDataFrame([("r1", "has", "a", "b")], "id string, name string, domain string, range string"), "axioms": spark.createDataFrame([("x", "subClassOf", "b", "a", 1.0)], "id string, axiom_type string, subject string, object string, confidence double")}
    e = Editor(spark, t)
    reader = Team(e).add("r", "reasoner")
    assert reader.use("is_a", "b", "a") and not reader.use("is_a", "a", "b")
    assert [tuple(x) for x in reader.use("relations_of", "b").collect()] == [("has", "b", "a", 1)]
    assert [tuple(x) for x in reader.use("properties_of", "a").collect()] == [("价", "a", 0)]
    e.delete("concepts", "a")
    e.save(str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o/relations")).count() == 0 and spark.read.parquet(str(tmp_path / "o/change_log")).count() == 1


def test_reified_relations_keep_their_links(spark):
    rel = spark.createDataFrame([("r1", "m", "a", "b", "N:M"), ("r2", "m", "a", "b", "N:M"), ("r3", "k", "a", None, "N:M"), ("r4", "k", "a", "b", "1:N")], "relation_id string, name string, domain string, range string, cardinality string")
    names = spark.createDataFrame([("a", "甲"), ("b", "乙")], "id string, name string")
    out = so.reify(rel, names).collect()
    made = so.reified_concepts(rel, names).collect()
    known = {"a", "b", None} | {x.id for x in made}
    assert len(out) == 6 and [(x.name, x.n_relations) for x in made] == [("甲_乙_Relation", 2)] and all(x.domain in known and x.range in known for x in out)


def test_closure_of_asked_nodes_only(spark):
    parent = {"a": None, "b": "a", "c": "b", "d": "a", "e": "c"}
    nodes = spark.createDataFrame([(c, p, D(2024, 1, 1)) for c, p in parent.items()], "concept_id string, parent_id string, updated_at timestamp_ntz")
    got = graph.tree_closure(nodes, spark.createDataFrame([("c",), ("a",), ("none",)], "id string"))
    assert {tuple(x) for x in got.collect()} == {("c", "b", 1), ("c", "a", 2)}
