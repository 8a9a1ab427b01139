import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ontoloom.operators import nested_json as nj

leaf = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text()
value = st.recursive(leaf, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(value, min_size=1, max_size=4), st.booleans())
def test_complete_agrees_with_a_parser(values, ascii_only):
    texts = [json.dumps(v, ensure_ascii=ascii_only) for v in values]
    cut = [t[:-1] for t in texts]
    x = nj.Index([t.encode("utf-8", "surrogatepass") for t in [*texts, *cut]])
    for i, t in enumerate([*texts, *cut]):
        try:
            json.loads(t)
            good = True
        except ValueError:
            good = False
        assert x.valid[i] == good, t


@settings(max_examples=100, deadline=None)
@given(st.lists(value, min_size=1, max_size=3), st.sampled_from([None, 1]))
def test_values_agree_with_a_parser(values, indent):
    x = nj.Index([json.dumps(v, indent=indent).encode() for v in values])

    def build(i):
        kids = [k for k in range(len(x.text)) if x.parent[k] == i]
        assert [x.place[k] for k in kids] == list(range(len(kids)))
        if x.kind[i] == nj.OBJECT:
            return {x.string(int(x.key_lo[k]), int(x.key_hi[k])): build(k) for k in kids}
        return [build(k) for k in kids] if x.kind[i] == nj.ARRAY else json.loads(x.buf[x.lo[i] : x.hi[i]])

    assert [build(i) for i in range(len(values))] == values


@pytest.mark.parametrize("t", ["", " ", "{", "}", "[1,]", "[,1]", "{,}", '{"a":}', '{"a" 1}', '{"a":1,}', '{1:2}', "[1:2]", "[1]]", "[[1]", "{]", "[}", '"a', '"a"b', '{"a":1}{"b":2}', "[1]2", "nul", "01", '["\\x"]', '["\\u12g4"]', "[1 2]", '{"a":"b" "c"}', '[{"a":1} 2]'])
def test_broken_texts(t):
    x = nj.Index([b'{"a": [1]}', t.encode(), b"[2]"])
    assert x.valid.tolist() == [True, False, True]


def rows_of(record, lists):
    """Brute force over parsed JSON: {row_id: (path, parent_id, pos, fields)}."""
    out = {"": ("", None, 0, {})}

    def text(v):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    def new(path, up, pos):
        rid = f"{up}/{path}[{pos}]"
        out[rid] = (path, up, pos, {})
        return rid

    def put(rid, name, v):
        f = out[rid][3]
        f[name] = max(f[name], text(v)) if name in f else text(v)

    def elements(v, path, rid):
        for k, e in enumerate(v):
            if e is not None:
                visit(e, path, "", new(path, rid, k), True)

    def visit(v, path, name, rid, element):
        if isinstance(v, dict):
            if not element and path in lists:
                rid, name = new(path, rid, 0), ""
            for k, w in v.items():
                visit(w, f"{path}.{k}" if path else k, f"{name}.{k}" if name else k, rid, False)
        elif isinstance(v, list):
            if any(isinstance(e, dict) for e in v) or not element and path in lists:
                elements(v, path, rid)
            else:
                put(rid, name, v)
        elif v is not None:
            put(rid, name, v)

    visit(record, "", "", "", False)
    return {k: (p, u, q, sorted(f.items())) for k, (p, u, q, f) in out.items()}


plain = st.none() | st.booleans() | st.integers() | st.text("xyz", max_size=3)
nested = st.dictionaries(st.sampled_from("abc"), st.recursive(plain, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from("abc"), c, max_size=3), max_leaves=15), max_size=3)


@settings(max_examples=150, deadline=None)
@given(st.lists(nested, min_size=1, max_size=3), st.sets(st.sampled_from(["a", "b", "a.b", "a.b.c", "b.a"])))
def test_rows_of_any_record(records, lists):
    r = nj._Rows(frozenset(lists), None)
    tops = [r.add(k, "", "", -1, 0) for k in range(len(records))]
    r.walk([json.dumps(v).encode() for v in records], [(t, "", "", False) for t in tops])
    got = [{} for _ in records]
    for k in range(len(r.record)):
        up = r.parent[k]
        got[r.record[k]][r.name[k]] = (r.path[k], r.name[up] if up >= 0 else None, r.pos[k], sorted(r.fields[k].items()))
    assert got == [rows_of(v, lists) for v in records]


def found(spark, payloads):
    rows = [(i, p, "other") for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "report_id bigint, payload string, label string")
    return sorted(tuple(r) for r in nj.found(df).collect())


def chain(v):
    return json.dumps({"scenarios": [None, {"result": {"proof_chain": v}}]})


def test_forms_of_lists(spark):
    e = {"rule": "r", "premise": "p"}
    assert found(spark, [chain([e, None, {"rule": None}])]) == [(0, "proof_step", 1, 0, "r"), (0, "proof_step", 1, 2, "")]
    assert found(spark, [chain(e)]) == [(0, "proof_step", 1, 0, "r")]
    assert found(spark, [chain(json.dumps([e, e]))]) == [(0, "proof_step", 1, 0, "r"), (0, "proof_step", 1, 1, "r")]
    assert found(spark, [chain([]), chain(None), chain("no json"), None, "", "{", "[1", chain([e])[:-2], '{"a":1} x']) == []


def test_deliveries_count_once_and_checks(spark):
    p = json.dumps({"steps": [{"output": {"checks": [{"concept": "c"}, {"child": "x"}]}}, {"output": None}, {}]})
    df = spark.createDataFrame([(1, p), (1, p + " "), (1, p[:20])], "report_id bigint, payload string")
    assert sorted(tuple(r) for r in nj.found(df).collect()) == [(1, "check", 0, 0, "c"), (1, "check", 0, 1, "")]


def test_layers_of_text(spark):
    e = json.dumps([{"rule": "r"}, None, json.dumps({"rule": "s"})])
    whole = json.dumps({"scenarios": json.dumps(json.dumps([{"result": json.dumps({"proof_chain": json.dumps(e)})}]))})
    assert found(spark, [whole, json.dumps(whole)])[:2] == [(0, "proof_step", 0, 0, "r"), (0, "proof_step", 0, 2, "s")]


def test_links_and_empty(spark, tmp_path):
    rows = [(5, chain([{"rule": "r", "n": {"x": 1}}, {"rule": "q"}])), (6, json.dumps({"other": [{"deep": [{"v": 2}, 3]}], "tags": ["a"]})), (5, "{")]
    spark.createDataFrame(rows, "report_id bigint, payload string").write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    t = nj.flat_tables(df)
    assert sorted(t) == ["", "other", "other.deep", "scenarios", "scenarios.result.proof_chain"]
    steps = {r.pos: r for r in t["scenarios.result.proof_chain"].collect()}
    assert steps[0].parent_id == t["scenarios"].first().row_id and t["scenarios"].first().parent_id == ""
    assert [tuple(f) for f in steps[0].fields] == [("n.x", "1"), ("rule", "r")] and steps[1].parent_pos == 1
    assert {tuple(f) for r in t["other.deep"].collect() for f in r.fields} == {("v", "2"), ("", "3")}
    assert [tuple(f) for r in t[""].where("report_id = 6").collect() for f in r.fields] == [("tags", '["a"]')]
    assert nj.flatten(df.limit(0), nj.LISTS).count() == 0 and nj.list_paths(df.limit(0)) == []


def test_differing_deliveries_stay_whole(spark):
    df = spark.createDataFrame([(1, chain([{"rule": "a", "premise": "z"}])), (1, chain([{"rule": "b", "premise": "y"}]))], "report_id bigint, payload string")
    kept = nj.flatten(df, nj.LISTS).where("path = 'scenarios.result.proof_chain'").collect()
    assert len(kept) == 1 and dict(tuple(f) for f in kept[0].fields) in ({"rule": "a", "premise": "z"}, {"rule": "b", "premise": "y"})
