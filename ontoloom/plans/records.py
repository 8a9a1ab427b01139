"""Queries of the core record problems (1, 2, 6) for the driver, with SQL where SQL can express them."""

from __future__ import annotations

from ontoloom.operators import hierarchy, nested_json, orphans
from ontoloom.session import table


def p1_found(spark, d):
    return nested_json.found(table(spark, d, "report_raw"))


def p1_nodes(spark, d):
    return nested_json.nodes(table(spark, d, "report_raw"))


def _orphans(spark, d):
    return orphans.orphans({t: table(spark, d, t) for t in orphans.FIELDS}, table(spark, d, "onto_concept"), table(spark, d, "change_log"))


def p2_found(spark, d):
    return _orphans(spark, d)


def p2_report(spark, d):
    return orphans.report(_orphans(spark, d))


def p6_found(spark, d):
    return hierarchy.found(table(spark, d, "taxonomy_node"))


def p6_nested_sets(spark, d):
    return hierarchy.nested_sets(table(spark, d, "taxonomy_node"))


def p6_descendants(spark, d):
    return hierarchy.descendants_of(hierarchy.shared_sets(table(spark, d, "taxonomy_node")))


def p6_paths(spark, d):
    return hierarchy.paths(table(spark, d, "taxonomy_node"))


QUERIES = {"p1_found": p1_found, "p1_nodes": p1_nodes, "p2_found": p2_found, "p2_report": p2_report, "p6_found": p6_found, "p6_nested_sets": p6_nested_sets, "p6_descendants": p6_descendants, "p6_paths": p6_paths}

#: White space that the identifiers' normal form strips, for RE2.
_ID = "nullif(lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"


def _id(c: str) -> str:
    return _ID.format(c)


_P2 = f"""
with con as (select {_id('id')} k, min(loaded_at) first_load from onto_concept group by 1),
chg as (select {_id('ref')} k, arg_max(lower(trim(op)), (changed_at, change_id)) op from change_log
        where lower(trim(target)) = 'concept' and lower(trim(op)) in ('create', 'delete') group by 1),
refs as (select 'onto_property' ref_table, id row_id, 'domain_concept_id' ref_field, {_id('domain_concept_id')} k, created_at, loaded_at from onto_property
  union all select 'onto_relation', id, 'domain_concept_id', {_id('domain_concept_id')}, created_at, loaded_at from onto_relation
  union all select 'onto_relation', id, 'range_concept_id', {_id('range_concept_id')}, created_at, loaded_at from onto_relation),
one as (select ref_table, row_id, ref_field, arg_min(k, loaded_at) k, min(created_at) created_at, min(loaded_at) loaded_at from refs group by 1, 2, 3),
found as (select ref_table, row_id, ref_field, strftime(created_at, '%Y-%m') period,
  case when con.k is null then 'missing' when chg.op = 'delete' then 'deleted' when con.first_load > one.loaded_at then 'late' end reason
  from one left join con on con.k = one.k left join chg on chg.k = one.k where one.k is not null)
"""

_P6 = f"""
with recursive v as (select {_id('concept_id')} id, {_id('parent_id')} parent, updated_at from taxonomy_node),
last as (select id, arg_max(coalesce(parent, ''), (updated_at, coalesce(parent, ''))) parent from v where id is not null group by id),
l as (select a.id, b.id parent from last a left join last b on a.parent = b.id),
t as (select id, parent, id root, 0 depth, id path from l where parent is null
  union all select l.id, l.parent, t.root, t.depth + 1, t.path || '/' || l.id from l join t on l.parent = t.id)
"""



def _list(x: str) -> str:
    """SQL list of the elements that a JSON value stands for."""
    inner = f"(case when json_type({x}) = 'VARCHAR' and json_valid({x} ->> '$') then {x} ->> '$' else 'null' end)::json"
    of = lambda v: f"case json_type({v}) when 'ARRAY' then json_extract({v}, '$[*]') when 'OBJECT' then [{v}] else []::json[] end"
    return f"case when json_type({x}) = 'VARCHAR' then {of(inner)} else {of(x)} end"


def _p1(outer: str, via: str, inner: str, label: str, kind: str) -> str:
    return f"""select distinct report_id, '{kind}' as child_kind, (i - 1)::integer as parent_pos, (j - 1)::integer as pos, coalesce(case when json_type(e[j], '$.{label}') = 'NULL' then null else json_extract_string(e[j], '$.{label}') end, '') as label
 from (select report_id, i, e, unnest(range(1, len(e) + 1)) j from (select report_id, i, {_list(f"json_extract(o[i], '$.{via}.{inner}')")} e
 from (select report_id, o, unnest(range(1, len(o) + 1)) i from (select report_id, {_list(f"json_extract(p, '$.{outer}')")} o from r)))) where json_type(e[j]) <> 'NULL'"""


def _text(x: str, *names: str) -> str:
    """SQL text of the first of an object's members that isn't null."""
    return "coalesce(" + ", ".join(f"case when json_type({x}, '$.{n}') = 'NULL' then null else json_extract_string({x}, '$.{n}') end" for n in names) + ")"


def _p1_nodes(outer: str, via: str, inner: str, labels: tuple, outer_kind: str, kind: str) -> str:
    return f"""select report_id, '{outer_kind}' as node_kind, null::integer as parent_pos, (i - 1)::integer as pos, coalesce({_text('o[i]', 'id', 'name')}, '') as label, {_text('o[i]', 'title', 'description')} as detail
 from (select report_id, o, unnest(range(1, len(o) + 1)) i from (select report_id, {_list(f"json_extract(p, '$.{outer}')")} o from r)) where json_type(o[i]) <> 'NULL'
 union select report_id, '{kind}', (i - 1)::integer, (j - 1)::integer, coalesce({_text('e[j]', *labels)}, ''), {_text('e[j]', 'premise', 'expected_relation')}
 from (select report_id, i, e, unnest(range(1, len(e) + 1)) j from (select report_id, i, {_list(f"json_extract(o[i], '$.{via}.{inner}')")} e
 from (select report_id, o, unnest(range(1, len(o) + 1)) i from (select report_id, {_list(f"json_extract(p, '$.{outer}')")} o from r)))) where json_type(e[j]) <> 'NULL'"""


_P1 = "with r as (select report_id, payload::json p from report_raw where payload is not null and json_valid(payload)) " + _p1("scenarios", "result", "proof_chain", "rule", "proof_step") + " union all " + _p1("steps", "output", "checks", "concept", "check")
_P1_NODES = _P1[: _P1.index("select distinct")] + "select report_id, 'report' as node_kind, null::integer as parent_pos, 0::integer as pos, '' as label, null as detail from r union " + _p1_nodes("scenarios", "result", "proof_chain", ("rule",), "scenario", "proof_step") + " union " + _p1_nodes("steps", "output", "checks", ("concept",), "step", "check")
_P6_FOUND = _P6.rstrip() + """, rest as (select id, parent from l where id not in (select id from t)),
w as (select id as start, id as at_, [id] path from rest union all select w.start, r.parent, list_append(w.path, r.parent) from w join rest r on r.id = w.at_ where not list_contains(w.path, r.parent)),
far as (select start, arg_max(path, len(path)) path, arg_max(at_, len(path)) at_ from w group by 1),
e as (select start, path, list_position(path, r.parent) k from far join rest r on r.id = far.at_)
select id as concept_id, 'tree' as state, root as root_id, depth from t union all select start, case when k = 1 then 'cycle' else 'hanging' end, list_min(path[k:]), (k - 1)::integer from e"""

_P6_UP = _P6.rstrip() + ", up as (select id, p[i] anc from (select id, string_split(path, '/') p, unnest(range(1, len(string_split(path, '/')))) i from t))"
_P6_SETS = _P6_UP + """, n as (select anc, count(*) n from up group by 1),
o as (select id, row_number() over (order by list_transform(string_split(path, '/'), lambda x: md5(x))) - 1 lo from t)
select t.id as concept_id, t.parent as parent_id, t.root as root_id, t.depth::integer as depth, coalesce(n.n, 0) as n_descendants, o.lo as lo, o.lo + coalesce(n.n, 0) as hi
 from t join o on o.id = t.id left join n on n.anc = t.id"""

ORACLE = {
    "p1_found": _P1,
    "p1_nodes": _P1_NODES,
    "p6_found": _P6_FOUND,
    "p2_found": _P2 + "select * from found where reason is not null",
    "p2_report": _P2 + "select ref_table, ref_field, period, reason, count(*) n_refs from found where reason is not null group by all",
    "p6_nested_sets": _P6_SETS,
    "p6_descendants": _P6_UP + "select anc as concept_id, id as descendant_id from up",
    "p6_paths": _P6 + "select id concept_id, path from t",
}
