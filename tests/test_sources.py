import json

import pytest
from pyspark.sql import functions as F

from ontoloom import hooks
from ontoloom.sources import ddl, files, views

SQL = """
-- two tables; a semicolon and a comma stand in comments
CREATE TABLE IF NOT EXISTS `user` (
  id BIGINT PRIMARY KEY COMMENT 'key; of, user',
  kind ENUM('a', 'b,c') COMMENT 'kind',
  price DECIMAL(10,2) NOT NULL,
  boss BIGINT REFERENCES person(pid)
) ENGINE=InnoDB COMMENT='users';
create table link (a BIGINT, b BIGINT, PRIMARY KEY (a, b), CONSTRAINT fk FOREIGN KEY (a) REFERENCES `user`(id), FOREIGN KEY (b) REFERENCES tag(tid));
CREATE TABLE broken (x INT
"""


def test_ddl():
    t = ddl.parse(SQL)
    assert [x["table_name"] for x in t] == ["user", "link"]
    u, link = t
    assert u["comment"] == "users" and u["columns"][0] == {"name": "id", "type": "BIGINT", "comment": "key; of, user", "enum_values": [], "is_primary_key": True}
    assert u["columns"][1]["enum_values"] == ["a", "b,c"] and u["columns"][2]["type"] == "DECIMAL(10,2)"
    assert u["foreign_keys"] == [{"fk_column": "boss", "ref_table": "person", "ref_column": "pid"}]
    assert all(c["is_primary_key"] for c in link["columns"]) and [f["ref_table"] for f in link["foreign_keys"]] == ["user", "tag"]


def test_ddl_frame(spark):
    df = spark.createDataFrame([("f", SQL, 1), ("n", None, 2), ("e", "", 3), ("t", "no ddl to create", 4)], "source string, text string, name int")
    p = ddl.tables(df)
    assert p.count() == 2 and ddl.columns(p).count() == 6 and ddl.foreign_keys(p).count() == 3
    assert ddl.tables(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 标题\n正文", encoding="utf-8")
    (tmp_path / "b.html").write_text("<html><script>x=1</script><p>a &amp; b</p></html>")
    (tmp_path / "c.bin").write_text("no")
    got = {r.path.rpartition("/")[2]: r.text for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# 标题\n正文", "b.html": "x=1a & b"}
    (tmp_path / "q.jsonl").write_text('{"sql": "select 1", "frequency": 3}\n{"query": "select 2"}\nselect 3\n\n')
    q = [tuple(r) for r in files.query_log(spark, str(tmp_path / "q.jsonl")).orderBy("sql").collect()]
    assert q == [("select 1", 3), ("select 2", None), ("select 3", None)]
    assert files.config(str(tmp_path / "none.yaml")) == {} and files.html_text(None) is None


def test_ontology_round_trip(spark, tmp_path):
    t = {"concepts": spark.createDataFrame([("c1", "客户")], "id string, name string"), "query_patterns": spark.createDataFrame([("q", 1)], "id string, n int")}
    files.save_ontology(t, str(tmp_path / "o"))
    back = files.load_ontology(spark, str(tmp_path / "o"))
    assert {k: v.collect() for k, v in back.items()} == {k: v.collect() for k, v in t.items()}
    (tmp_path / "o.json").write_text(json.dumps({"version": "2.0", "concepts": [{"id": "c1"}], "axioms": []}))
    assert files.load_ontology(spark, str(tmp_path / "o.json"))["concepts"].first().id == "c1"


def test_views(spark):
    r = spark.createDataFrame([("has", "A", "B", "1:N"), ("in", "B", "C", "N:M")], "name string, domain string, range string, cardinality string")
    assert "A -->|has| B" in views.flow_graph(r) and "B }o--o{ C : in" in views.er_diagram(r) and "2 rows" in views.markdown(r)
    assert "`P` <|-- `C`" in views.class_diagram(spark.createDataFrame([("C", "P")], "child string, parent string"))
    bad = spark.createDataFrame([("p", None, "int"), ("q", "n", "point")], "id string, name string, value_type string")
    assert {(x.field, x.n) for x in views.schema_violations(bad, "properties").where("n > 0").collect()} == {("name", 1), ("value_type:enum", 1)}
    assert "concepts" in views.json_schema()["required"]


@pytest.mark.parametrize("text, want", [('{"a": 1}', {"a": 1}), ('so:\n```json\n[1]\n```', [1]), ('x {no} {"b": 2} y', {"b": 2}), ("", {}), (None, {}), ("none", {})])
def test_tolerant_json(text, want):
    assert hooks.tolerant_json(text) == want


def test_hook(spark):
    p = spark.createDataFrame([("1", "a"), ("2", "b")], "prompt_id string, prompt string")
    assert {r.answer for r in hooks.ask(p).collect()} == {""}
    assert {r.answer for r in hooks.ask(p, lambda xs: [x.upper() for x in xs]).collect()} == {"A", "B"}

    def fails(xs):
        raise RuntimeError

    assert {r.answer for r in hooks.ask(p, fails).collect()} == {""}


def test_pipeline(spark, tmp_path):
    from ontoloom import pipeline

    d = tmp_path
    for k in ("ddl", "docs", "queries"):
        (d / k).mkdir()
    (d / "ddl/a.sql").write_text("CREATE TABLE customer (customer_id BIGINT PRIMARY KEY COMMENT '编号', customer_name VARCHAR(50) COMMENT '姓名') COMMENT '客户信息表'; CREATE TABLE orders (order_id BIGINT PRIMARY KEY COMMENT '编号', customer_id BIGINT COMMENT '客户', total DECIMAL(10,2) COMMENT '金额', FOREIGN KEY (customer_id) REFERENCES customer(customer_id)) COMMENT '订单表'; CREATE TABLE tmp_1 (c1 INT);", encoding="utf-8")
    (d / "docs/a.md").write_text("客户是一种用户。如果客户在24小时内未支付，订单将自动取消。管理员可以查看订单信息。浏览商品 → 加入购物车 → 支付", encoding="utf-8")
    (d / "queries/q.jsonl").write_text('{"sql": "SELECT customer_id FROM orders WHERE total > 1", "frequency": 5}\n')
    (d / "c.yaml").write_text("business_terms: [订单]\npermission_subjects:\n  - {name: 管理员, type: role}\nconcept_synonyms:\n  - {standard: 客户, aliases: [顾客]}\n", encoding="utf-8")
    t = pipeline.run(spark, str(d / "ddl/*.sql"), str(d / "docs"), str(d / "queries/*.jsonl"), str(d / "c.yaml"))
    names = {r.name for r in t["concepts"].collect()}
    assert {"客户", "订单"} <= names and "tmp_1" not in names
    assert {r.name for r in t["relations"].collect()} == {"hasCustomer"}
    assert {(r.source_ref, r.value_type) for r in t["properties"].collect()} >= {("orders.total", "float")}
    assert t["trigger_rules"].first().action_detail == "取消" and t["service_compositions"].first().n_steps == 3
    assert t["permission_rules"].first().actions == "read" and t["query_patterns"].first().weight == 5
    assert t["glossary_terms"].where(F.col("term") == "客户").first().synonyms == "顾客"
    assert t["axioms"].count() >= 2
