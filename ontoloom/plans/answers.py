"""Queries that answer with content: proofs, inherited facts, counterfactual differences, paths, routed answers and contexts; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.operators import concepts as con
from ontoloom.operators import context, graph, hierarchy, models, reason
from ontoloom.plans.reasoning import _ALL, _SLICE, _facts_prop, _facts_rel, _sets, concepts, properties, relations, relevant_slice
from ontoloom.session import cut, once, table


def _nodes(s, d):
    return table(s, d, "taxonomy_node")


def _inherited(s, d, kind):
    """Facts of all nodes with their origins, made once per state of the tables."""
    facts = {"relations": _facts_rel, "properties": _facts_prop}[kind]
    source = _nodes(s, d)

    def build(nodes):
        return reason.inherited(graph.tree_closure(nodes), facts(s, d), _sets(s, d).select(F.col("concept_id").alias("id")))

    return once(f"inherited:{kind}:{d}", source, build)


def relations_of(s, d):
    return reason.tagged(_inherited(s, d, "relations")).withColumn("distance", F.col("distance").cast("bigint"))


def properties_of(s, d):
    return reason.tagged(_inherited(s, d, "properties")).withColumn("distance", F.col("distance").cast("bigint"))


def is_a_proofs(s, d):
    q = relations(s, d).select(F.col("domain").alias("child"), F.col("range").alias("parent")).where("child is not null and parent is not null")
    up = _nodes(s, d)
    own = hierarchy.links(up).where("parent is not null").select(F.col("id").alias("child"), "parent")
    root = _sets(s, d).where("depth > 0").select(F.col("concept_id").alias("child"), F.col("root_id").alias("parent"))
    return reason.proofs(q.unionByName(own).unionByName(root), _sets(s, d), hierarchy.shared_ways(up)).withColumn("distance", F.col("distance").cast("bigint"))


def cf_subclass_lost(s, d):
    e = hierarchy.links(_nodes(s, d)).where("parent is not null").select(F.col("id").alias("child"), "parent")
    tree = e.join(_sets(s, d).select(F.col("concept_id").alias("child")), "child", "left_semi")
    return reason.lost_facts(tree, {k: _inherited(s, d, k) for k in ("relations", "properties")})


def cf_subclass_gained(s, d):
    """For each relation the facts that its domain would gain below its range, where neither is above the other."""
    q = relations(s, d).select(F.col("domain").alias("child"), F.col("range").alias("parent")).where("child is not null and parent is not null and child != parent").distinct()
    gains = reason.add_subclass(q, _sets(s, d)).where("outcome = 'gains'")
    return reason.gained_facts(gains, {k: _inherited(s, d, k) for k in ("relations", "properties")})


def cf_relation_holders(s, d):
    """Concepts that lose a relation of a name, and what they keep."""
    inh = _inherited(s, d, "relations")
    all_ = reason.names(inh, "id", "fact", "facts")
    kept = F.array_join(F.array_remove(F.split("facts", r"\|"), F.col("fact")), "|")
    return inh.join(all_, "id").select("fact", "id", F.when(F.col("distance") == 0, "direct").otherwise("inherited").alias("how"), kept.alias("kept"))


def cf_concept_effects(s, d):
    """What removing each concept breaks beside its relations: children and descendants below it, the links it is in, its properties by name."""
    sets = _sets(s, d)
    l = hierarchy.links(_nodes(s, d)).where("parent is not null")
    c = concepts(s, d).select("id")
    kids = l.groupBy(F.col("parent").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("id")), "|").alias("orphans"))
    axioms = l.select(F.explode(F.array_distinct(F.array("id", "parent"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_axioms"))
    props = reason.names(properties(s, d).where("owner is not null").withColumnRenamed("owner", "cid"), "cid", "name", "lost_properties").withColumnRenamed("cid", "id")
    j = c.join(kids, "id", "left").join(axioms, "id", "left").join(props, "id", "left").join(sets.select(F.col("concept_id").alias("id"), "n_descendants"), "id", "left")
    e = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return j.select("id", e("orphans"), F.coalesce("n_axioms", F.lit(0)).alias("n_axioms"), e("lost_properties"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def describe_inherited(s, d):
    """Each tree concept with its ancestors from the root and all relations and properties it has or inherits."""
    c = concepts(s, d).select("id", "name")
    w = hierarchy.shared_ways(_nodes(s, d)).select(F.col("concept_id").alias("id"), F.array_join("way", "/").alias("path"))
    r = reason.names(_inherited(s, d, "relations"), "id", "fact", "relations")
    p = reason.names(_inherited(s, d, "properties"), "id", "fact", "properties")
    j = c.join(w, "id").join(r, "id", "left").join(p, "id", "left")
    return j.select("id", "name", "path", F.coalesce("relations", F.lit("")).alias("relations"), F.coalesce("properties", F.lit("")).alias("properties"))


def find_paths(s, d):
    """Search: from the domain of each relation whose number is divisible by 100 to the range of the relation after it, over all relations with inherited ones."""
    r = relations(s, d)
    q = r.where("conv(right(relation_id, 8), 16, 10) % 100 = 0 and domain is not null").select("relation_id", F.col("domain").alias("src"))
    to = r.where("range is not null").select("range", F.conv(F.expr("right(relation_id, 8)"), 16, 10).cast("bigint").alias("no")).groupBy((F.col("no") % 97).alias("k")).agg(F.min("range").alias("dst"))
    asked = q.withColumn("k", F.conv(F.expr("right(relation_id, 8)"), 16, 10).cast("bigint") % 97).join(to, "k").where("src != dst").select("src", "dst")
    return graph.shortest_paths(r, asked, _sets(s, d), 3).withColumn("hops", F.col("hops").cast("bigint"))


def symbolic_answers(s, d):
    """All questions routed by category and answered from the concepts they mention; only for these are ancestors and inherited facts looked up."""
    q = table(s, d, "qa_dataset").groupBy(F.col("id").alias("question_id")).agg(F.max("question").alias("question"), F.max("category").alias("category"))
    c = concepts(s, d).select("id", "name")
    m = cut(reason.mentioned(q, c))
    asked = cut(m.where("rank = 1").select("id").distinct())
    known = asked.join(c, "id", "left_semi")
    ways = hierarchy.shared_ways(_nodes(s, d)).withColumnRenamed("concept_id", "id").join(known, "id", "left_semi")
    closure = graph.tree_closure(_nodes(s, d), asked)
    tree = _sets(s, d).select(F.col("concept_id").alias("id")).join(asked, "id", "left_semi")
    owned = cut(properties(s, d).select("owner", "name", "formula").where("owner is not null"))
    rel = cut(reason.names(reason.inherited(closure, _facts_rel(s, d), tree), "id", "fact", "answer"))
    prop = reason.names(reason.inherited(closure, owned.select("owner", F.col("name").alias("fact")), tree), "id", "fact", "properties")
    derived = owned.where("formula is not null and trim(formula) != ''").select(F.col("owner").alias("id"), F.concat_ws("=", "name", "formula").alias("fact")).join(asked, "id", "left_semi")
    described = ways.select("id", F.array_join("way", "/").alias("path")).join(rel.withColumnRenamed("answer", "relations"), "id", "left").join(prop, "id", "left")
    e = lambda x: F.coalesce(x, F.lit(""))
    describe = described.select("id", F.concat_ws("; ", "path", e("relations"), e("properties")).alias("answer"))
    return reason.dispatch(q, m, _sets(s, d), {"relations": rel, "derived": reason.names(derived, "id", "fact", "answer"), "describe": describe})


def context_text(s, d):
    """Contexts of the questions whose number is divisible by 100: concepts, other names, is-a links, relations, properties, derivations."""
    l = hierarchy.links(_nodes(s, d)).where("parent is not null")
    c = concepts(s, d)
    r = relations(s, d).where("domain is not null")
    p = properties(s, d).where("owner is not null")
    sections = [
        c.select("id", F.concat(F.lit("concept: "), "name").alias("line")),
        c.select("id", F.explode("aliases").alias("a")).select("id", F.concat("id", F.lit(" also "), "a").alias("line")),
        l.select("id", F.concat("id", F.lit(" is a "), "parent").alias("line")),
        r.select(F.col("domain").alias("id"), F.concat("domain", F.lit(" "), "name", F.lit(" "), F.coalesce("range", F.lit("?"))).alias("line")),
        p.select(F.col("owner").alias("id"), F.concat("owner", F.lit(" has "), "name", F.lit(": "), F.coalesce("value_type", F.lit("?"))).alias("line")),
        p.where("trim(formula) != ''").select(F.col("owner").alias("id"), F.concat("owner", F.lit(" derives "), "name", F.lit(" = "), "formula").alias("line")),
    ]
    return context.as_text(relevant_slice(s, d), sections)


def _texts(s, d):
    return concepts(s, d).where("name is not null").groupBy(F.lower("name").alias("text")).agg(F.min("id").alias("id"))


def merge_semantic(s, d):
    """Names of cosine 0.85 or more, each by its least concept; those from 0.75 on go to a judge, who without a model says no."""
    links = cut(con.cosine_texts(cut(_texts(s, d)), 0.75))
    return models.judge(links, concepts(s, d).select("id", "name"))


def merge_classes(s, d):
    """Transitive merge over equal names, edit similarity and cosine links."""
    return con.merge_similar(concepts(s, d), more=con.cosine_texts(cut(_texts(s, d)), 0.85, summed=True))


QUERIES = {q.__name__: q for q in (relations_of, properties_of, is_a_proofs, cf_subclass_lost, cf_subclass_gained, cf_relation_holders, cf_concept_effects, describe_inherited, find_paths, symbolic_answers, context_text, merge_semantic, merge_classes)}

_INH = ", inh as (select id, fact, min(dist) dist, arg_min(owner, (dist, owner)) origin from (select u.id, f.fact, f.owner, u.dist from up u join (select distinct {0} as owner, name fact from {1} where {2}) f on f.owner = u.anc) group by 1, 2)"
_REL, _PROP = (_INH.format("domain", "rel", "domain is not null"), _INH.format("owner", "prop", "owner <> ''").replace("inh as", "pinh as"))
_TAG = "select id, fact, origin, dist as distance, case when dist = 0 then 'direct' else 'inheritance' end as how from "
_LIST = "array_to_string(list_sort(list_distinct(list({0}))), '|')"
_RN, _PN = (f", {a} as (select id, {_LIST.format('fact')} v from {b} group by 1)" for a, b in (("rn", "inh"), ("pn", "pinh")))
_HEX = "('0x' || right(relation_id, 8))::bigint"
_STEP = "(select distinct u.id at_, rel.name, rel.range from up u join rel on rel.domain = u.anc where rel.range is not null union select domain, name, range from rel where domain is not null and range is not null and domain not in (select id from t))"


def _hop(k: int) -> str:
    seen = " union all ".join(f"select src, dst, at_ from h{i}" for i in range(k))
    return f", n{k} as (select c.src, c.dst, st.range at_, min(case when c.path = '' then st.name else c.path || '→' || st.name end) path from c{k - 1} c join st on st.at_ = c.at_ group by 1, 2, 3), h{k} as (select * from n{k} where (src, dst, at_) not in ({seen})), c{k} as (select * from h{k} where (src, dst) not in (select (src, dst) from h{k} where at_ = dst))"


_PATHS = _ALL + f""", to_ as (select {_HEX} % 97 k, min(range) dst from rel where range is not null group by 1), asked as (select distinct domain src, to_.dst from rel join to_ on to_.k = {_HEX} % 97 where {_HEX} % 100 = 0 and domain is not null and domain <> to_.dst),
st as {_STEP}, h0 as (select src, dst, src at_, '' path from asked), c0 as (select * from h0)""" + "".join(_hop(k) for k in (1, 2, 3)) + " " + " union all ".join(f"select src, dst, {k} as hops, path from h{k} where at_ = dst" for k in (1, 2, 3))
#: Links of similar names by dynamic programming over all pairs whose lengths and characters don't rule them out, and the classes that they and further links make.
_SIMILAR = _ALL + """, sn as (select distinct lower(regexp_replace(name, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) nm from con where name is not null), sc as (select nm, string_split(nm, '') c, list_distinct(string_split(nm, '')) u, length(nm) n from sn where nm <> ''),
sp as (select x.nm a, y.nm b, x.c ac, y.c bc, x.n + y.n n from sc x join sc y on x.nm < y.nm and 2 * least(x.n, y.n) >= .85 * (x.n + y.n) and len(x.u) + len(y.u) - 2 * len(list_intersect(x.u, y.u)) <= .15 * (x.n + y.n) + 1e-9),
sl as (select a, b from sp where round(2.0 * (list_reduce(bc, lambda r, ch: list_reduce(range(1, len(ac) + 1), lambda q, j: list_append(q, greatest(q[-1], r[j + 1], r[j] + (ac[j] = ch)::int)), [0]), list_transform(range(len(ac) + 1), lambda z: 0)))[-1] / n, 6) >= .85)"""
_CLASSES = """, lk as (select a, b from __LINKS__ union select b, a from __LINKS__), re as (select nm a, nm b from sn union select re.a, lk.b from re join lk on lk.a = re.b), cp as (select a nm, min(b) k from re group by 1),
ids as (select id, lower(regexp_replace(name, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) nm from con where name is not null), least_ as (select k, min(id) c from ids join cp using (nm) group by 1), nl as (select nm, count(*) n from (select a nm from sl union all select b from sl) group by 1)
select ids.id, least_.c as component, coalesce(nl.n, 0) as n_links from ids join cp using (nm) join least_ using (k) left join nl using (nm)"""
_COS = """, nm as (select lower(name) txt, min(id) id from con where name is not null group by 1), g as (select id, substring(txt, i, 3) g, 1.0::double w from (select id, txt, unnest(range(1, length(txt) - 1)) i from nm) union all select id, substring(txt, i, 2), .5 from (select id, txt, unnest(range(1, length(txt))) i from nm)),
gs as (select id, g, sum(w) s from g group by 1, 2), gv as (select id, g, round(s / sqrt(sum(s * s) over (partition by id)), 6) w from gs), gp as (select x.id a, y.id b, round(sum(x.w * y.w), 4) c from gv x join gv y on x.g = y.g and x.id < y.id group by 1, 2)"""
ORACLE = {
    "merge_components": _SIMILAR + _CLASSES.replace("__LINKS__", "sl"),
    "merge_classes": _SIMILAR + _COS + ", im as (select id, lower(regexp_replace(name, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) nm from con where name is not null), al as (select a, b from sl union select x.nm, y.nm from gp join im x on x.id = gp.a join im y on y.id = gp.b where c >= .85 and x.nm <> y.nm)" + _CLASSES.replace("__LINKS__", "al"),
    "relations_of": _ALL + _REL + _TAG + "inh",
    "properties_of": _ALL + _PROP + _TAG + "pinh",
    "is_a_proofs": _ALL + """, q as (select distinct domain child, range parent from rel where domain is not null and range is not null union select id, parent from l where parent is not null union select id, root from t where depth > 0),
w as (select id, list_reverse(string_split(path, '/')) up from t) select q.child, q.parent, case when a.id is not null and b.id is not null then u.id is not null end as answer, u.dist as distance, case when u.id is not null then array_to_string(w.up[1:u.dist + 1], '→') end as proof
 from q left join t a on a.id = q.child left join t b on b.id = q.parent left join up u on u.id = q.child and u.anc = q.parent left join w on w.id = q.child""",
    "cf_subclass_lost": _ALL + _REL + _PROP + f", lr as (select id, {_LIST.format('fact')} v from inh where dist > 0 group by 1), lp as (select id, {_LIST.format('fact')} v from pinh where dist > 0 group by 1) select t.id as child, t.parent, coalesce(lr.v, '') as lost_relations, coalesce(lp.v, '') as lost_properties from t left join lr using (id) left join lp using (id) where t.parent is not null",
    "cf_subclass_gained": _ALL + _REL + _PROP + f""", q as (select distinct domain child, range parent from rel where domain is not null and range is not null and domain <> range), g as (select q.* from q join t a on a.id = q.child join t b on b.id = q.parent where (q.child, q.parent) not in (select (id, anc) from up) and (q.parent, q.child) not in (select (id, anc) from up)),
r as (select child, parent, {_LIST.format('fact')} v from g join inh on inh.id = g.parent where (child, fact) not in (select (id, fact) from inh) group by 1, 2), p as (select child, parent, {_LIST.format('fact')} v from g join pinh on pinh.id = g.parent where (child, fact) not in (select (id, fact) from pinh) group by 1, 2)
select g.child, g.parent, coalesce(r.v, '') as gained_relations, coalesce(p.v, '') as gained_properties from g left join r using (child, parent) left join p using (child, parent)""",
    "cf_relation_holders": _ALL + _REL + ", a as (select id, list_sort(list_distinct(list(fact))) v from inh group by 1) select fact, id, case when dist = 0 then 'direct' else 'inherited' end as how, array_to_string(list_filter(a.v, lambda x: x <> fact), '|') as kept from inh join a using (id)",
    "cf_concept_effects": _ALL + f", k as (select parent id, {_LIST.format('id')} v from l where parent is not null group by 1), a as (select id, count(*) n from (select id from l where parent is not null union all select parent from l where parent is not null and parent <> id) group by 1), p as (select owner id, {_LIST.format('name')} v from prop where owner <> '' group by 1) select con.id, coalesce(k.v, '') as orphans, coalesce(a.n, 0) as n_axioms, coalesce(p.v, '') as lost_properties, coalesce(sz.n - 1, 0) as n_descendants from con left join k using (id) left join a using (id) left join p using (id) left join sz using (id)",
    "describe_inherited": _ALL + _REL + _PROP + _RN + _PN + " select con.id, con.name, t.path, coalesce(rn.v, '') as relations, coalesce(pn.v, '') as properties from con join t using (id) left join rn using (id) left join pn using (id)",
    "find_paths": _PATHS,
    "merge_semantic": _ALL + _COS + " select a, b, c as cosine, c >= .85 as linked from gp where c >= .75",
    "symbolic_answers": _ALL + _REL + _PROP + _RN + _PN + f""", q as (select id question_id, lower(max(question)) q, max(category) category from qa_dataset group by 1), nm as (select lower(name) k, min(name) nm, min(id) id from con where length(name) >= 2 group by 1),
m as (select question_id, nm.id, row_number() over (partition by question_id order by length(nm) desc, nm) r from q join nm on contains(q.q, nm.k)), f as (select question_id, id from m where r = 1), g as (select question_id, id other from m where r = 2),
x as (select question_id, coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in reason.ROUTES.items())}}}[category], 'describe') route, f.id, g.other from q left join f using (question_id) left join g using (question_id)),
dv as (select owner id, {_LIST.format("name || '=' || formula")} v from prop where trim(formula) <> '' and owner <> '' group by 1)
select x.question_id, x.route, x.id as concept_id, case route when 'is_a' then case when other is not null and a.id is not null and b.id is not null then case when u.id is not null then '是' else '否' end end when 'relations' then rn.v when 'derived' then dv.v else case when a.id is not null and c.id is not null then a.path || '; ' || coalesce(rn.v, '') || '; ' || coalesce(pn.v, '') end end as answer
 from x left join t a on a.id = x.id left join t b on b.id = x.other left join up u on u.id = x.id and u.anc = x.other left join rn on rn.id = x.id left join pn on pn.id = x.id left join dv on dv.id = x.id left join con c on c.id = x.id""",
    "context_text": _SLICE + """, lines as (select question_id, 0 o, 'concept: ' || name line from slice join con using (id) union select question_id, 1, slice.id || ' also ' || a from slice join (select id, unnest(aliases) a from con) using (id) union select question_id, 2, slice.id || ' is a ' || l.parent from slice join l using (id) where l.parent is not null
 union select question_id, 3, rel.domain || ' ' || rel.name || ' ' || coalesce(rel.range, '?') from slice join rel on rel.domain = slice.id union select question_id, 4, prop.owner || ' has ' || prop.name || ': ' || coalesce(prop.value_type, '?') from slice join prop on prop.owner = slice.id union select question_id, 5, prop.owner || ' derives ' || prop.name || ' = ' || formula from slice join prop on prop.owner = slice.id where trim(formula) <> '')
select question_id, array_to_string(list(line order by o, line), chr(10)) as context from lines where line is not null group by 1""",
}
