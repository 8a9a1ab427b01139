"""Queries on the ontology: hierarchy, inheritance, counterfactuals, merging, relations, axioms, edits; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.functions.formula import compile_formula
from ontoloom.functions.ids import norm_id
from ontoloom.operators import concepts as con
from ontoloom.operators import context, enrich, graph, hierarchy, mining, reason
from ontoloom.operators import schema_ops as so
from ontoloom.plans.records import _P6, _id
from ontoloom.plans.texts import _PHRASES
from ontoloom.session import cut, table


def T(name):
    return lambda s, d: table(s, d, name)


def concepts(s, d):
    """One row per concept id: the latest loaded."""
    c = table(s, d, "onto_concept")
    cols = ["name", "name_en", "aliases", "description", "source", "source_ref", "confidence", "properties", "instance_count", "identity_spec"]
    return c.where("id is not null").groupBy(norm_id("id").alias("id")).agg(F.max_by(F.struct(*cols, "loaded_at"), "loaded_at").alias("v")).select("id", "v.*")


def properties(s, d):
    p = table(s, d, "onto_property")
    return p.groupBy("id").agg(F.max_by(F.struct(norm_id("domain_concept_id").alias("owner"), "name", "name_cn", "value_type", F.col("derivation_formula").alias("formula")), "loaded_at").alias("v")).select("id", "v.*")


def relations(s, d):
    r = table(s, d, "onto_relation")
    return r.groupBy(F.col("id").alias("relation_id")).agg(F.max_by(F.struct("name", norm_id("domain_concept_id").alias("domain"), norm_id("range_concept_id").alias("range"), "cardinality", "confidence", "aliases", "source_ref", "name_cn", "relation_type"), "loaded_at").alias("v")).select("relation_id", "v.*")


_CON = f"con as (select {_id('id')} id, arg_max(name, loaded_at) as name, arg_max(name_en, loaded_at) name_en, arg_max(coalesce(aliases, []), loaded_at) aliases, arg_max(coalesce(description, chr(1)), loaded_at) description, arg_max(source, loaded_at) as source, arg_max(coalesce(source_ref, ''), loaded_at) source_ref, arg_max(confidence, loaded_at) confidence, max(loaded_at) loaded_at, arg_max(instance_count, loaded_at) instance_count from onto_concept where id is not null group by 1)"
_PROP = f"prop as (select id, arg_max(coalesce({_id('domain_concept_id')}, ''), loaded_at) as owner, arg_max(name, loaded_at) as name, arg_max(value_type, loaded_at) value_type, arg_max(coalesce(derivation_formula, ''), loaded_at) formula from onto_property group by id)"
_REL = f"rel as (select id relation_id, arg_max(name, loaded_at) as name, nullif(arg_max(coalesce({_id('domain_concept_id')}, ''), loaded_at), '') as domain, nullif(arg_max(coalesce({_id('range_concept_id')}, ''), loaded_at), '') as range, arg_max(cardinality, loaded_at) as cardinality, arg_max(confidence, loaded_at) confidence, arg_max(coalesce(aliases, []), loaded_at) aliases, arg_max(coalesce(source_ref, ''), loaded_at) source_ref, arg_max(coalesce(name_cn, ''), loaded_at) name_cn from onto_relation group by id)"
#: Adds con, prop, rel and the tree t with its closure up(id, anc, dist) to the taxonomy's SQL.
_ALL = _P6.rstrip().rstrip(")") + f"), up as (select id, p[i] anc, len(p) - i dist from (select id, string_split(path, '/') p, unnest(range(1, len(string_split(path, '/')) + 1)) i from t)), sz as (select anc id, count(*) n from up group by 1), {_CON}, {_PROP}, {_REL} "
_BASE = f"with {_CON}, {_PROP}, {_REL} "


def _sets(s, d):
    return hierarchy.shared_sets(table(s, d, "taxonomy_node"))


def _closure(s, d):
    return graph.tree_closure(table(s, d, "taxonomy_node"))


def _tree_nodes(s, d):
    return hierarchy.climb(hierarchy.links(table(s, d, "taxonomy_node")))[0]


def _inherited(owner_of):
    def run(s, d):
        facts = owner_of(s, d)
        i = reason.inherited(_closure(s, d), facts, _tree_nodes(s, d))
        return i.groupBy("id").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if(F.col("distance") > 0).alias("n_inherited"), F.max("distance").cast("bigint").alias("farthest"))

    return run


def _facts_rel(s, d):
    return relations(s, d).select(F.col("domain").alias("owner"), F.col("name").alias("fact")).where("owner is not null")


def _facts_prop(s, d):
    return properties(s, d).select("owner", F.col("name").alias("fact")).where("owner is not null")


def _inherited_sql(src: str) -> str:
    return _ALL + f", f as (select distinct owner, fact from {src}), i as (select u.id, f.fact, min(u.dist) dist from up u join f on f.owner = u.anc group by 1, 2) select id, count(*) as n_facts, count(*) filter (where dist > 0) as n_inherited, max(dist) as farthest from i group by id"


def is_a_batch(s, d):
    q = relations(s, d).select(F.col("domain").alias("child"), F.col("range").alias("parent")).where("child is not null and parent is not null")
    return reason.is_a(q, _sets(s, d)).withColumn("distance", F.col("distance").cast("bigint"))


def constraint_check(s, d):
    """Each relation against the roots that most relations of its name have as domain and range."""
    r = relations(s, d)
    roots = _sets(s, d)
    by = roots.select(F.col("concept_id").alias("id"), "root_id")
    dom = so.vote(r.join(by.withColumnRenamed("id", "domain"), "domain").select(F.col("name").alias("predicate"), F.col("root_id").alias("cls")))
    ran = so.vote(r.join(by.withColumnRenamed("id", "range"), "range").select(F.col("name").alias("predicate"), F.col("root_id").alias("cls")))
    declared = dom.select(F.col("predicate").alias("name"), F.col("winner").alias("domain")).join(ran.select(F.col("predicate").alias("name"), F.col("winner").alias("range")), "name", "full")
    return reason.check_constraints(r, declared, roots)


_VOTE = "vote as (select predicate, arg_min(cls, (-n, cls)) w, max(n)::double / sum(n) share, sum(n)::bigint n from (select predicate, coalesce(cls, 'unknown') cls, count(*) n from tri group by 1, 2) group by 1)"
_VOTED = "select predicate, case when share >= .8 then w end as winner, round(share, 6) as share, case when share >= .95 then 'auto' when share >= .8 then 'review' else 'skip' end as status, n from vote"


def domain_vote(s, d):
    """Domain of each relation name: majority source layer of the concepts it starts from."""
    c = concepts(s, d).select(F.col("id").alias("domain"), F.lower(F.trim("source")).alias("cls"))
    return so.vote(relations(s, d).where("domain is not null").join(c, "domain", "left").select(F.col("name").alias("predicate"), "cls"))


def range_vote(s, d):
    return so.vote(properties(s, d).select(F.col("name").alias("predicate"), F.col("value_type").alias("cls")))


def infer_axioms(s, d):
    a = domain_vote(s, d).where("status = 'auto'").select(F.lit("domain").alias("axiom_type"), F.col("predicate").alias("subject"), F.col("winner").alias("object"), "share")
    return a.unionByName(range_vote(s, d).where("status = 'auto'").select(F.lit("range").alias("axiom_type"), F.col("predicate").alias("subject"), F.col("winner").alias("object"), "share"))


def axiom_risk(s, d):
    """subClassOf axioms of the taxonomy's latest edges, by risk and status."""
    n = table(s, d, "taxonomy_node").withColumn("id", norm_id("concept_id")).where("id is not null")
    e = n.groupBy("id").agg(F.max_by(F.struct(norm_id("parent_id").alias("parent"), "confidence"), F.struct("updated_at", norm_id("parent_id"), "confidence")).alias("v")).where("v.parent is not null")
    k = F.lit("subClassOf")
    return e.select("id", so.risk(k).alias("risk"), so.risk_status(k, F.col("v.confidence")).alias("status"))


def multiple_parents(s, d):
    """Nodes whose versions name parents under different roots."""
    n = table(s, d, "taxonomy_node").select(norm_id("concept_id").alias("child"), norm_id("parent_id").alias("parent")).where("child is not null and parent is not null")
    return graph.multiple_parents(n, _sets(s, d).select(F.col("concept_id").alias("id"), F.col("root_id").alias("root")))


def cf_remove_subclass(s, d):
    l = hierarchy.links(table(s, d, "taxonomy_node")).where("parent is not null").select(F.col("id").alias("child"), "parent")
    return reason.remove_subclass(l, _sets(s, d))


def cf_add_subclass(s, d):
    q = relations(s, d).select(F.col("domain").alias("child"), F.col("range").alias("parent")).where("child is not null and parent is not null and child != parent").distinct()
    return reason.add_subclass(q, _sets(s, d))


def cf_remove_relation(s, d):
    return reason.remove_relation(_facts_rel(s, d), _sets(s, d))


def cf_remove_concept(s, d):
    l = hierarchy.links(table(s, d, "taxonomy_node")).select("id", "parent")
    return reason.remove_concept(concepts(s, d).select("id"), l, relations(s, d), properties(s, d).where("owner is not null"))


def describe_concept(s, d):
    return reason.describe(concepts(s, d).select("id", "name"), _sets(s, d), properties(s, d).where("owner is not null"), relations(s, d).where("domain is not null"))


def resolve_refs(s, d):
    q = table(s, d, "qa_dataset")
    refs = properties(s, d).select(F.col("owner").alias("ref")).where("ref is not null").unionByName(q.select(F.explode(F.array("counterfactual_args.child", "counterfactual_args.parent", "counterfactual_args.concept")).alias("ref")).where("ref is not null"))
    return reason.resolve(refs, concepts(s, d).select("id", "name", "aliases", "loaded_at"))


_KEY = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_RESOLVE = _BASE + f""", k as (select id, loaded_at, {_KEY.format('id')} k, 1 p from con union all select id, loaded_at, {_KEY.format('name')}, 2 from con union all select id, loaded_at, {_KEY.format('a')}, 3 from (select id, loaded_at, unnest(aliases) a from con)),
b as (select k, min(p) p, arg_max(id, (-p, loaded_at, id)) id from k where k is not null and k <> '' group by k),
r as (select owner ref from prop where owner <> '' union select counterfactual_args.child from qa_dataset union select counterfactual_args.parent from qa_dataset union select counterfactual_args.concept from qa_dataset)
select distinct ref, b.id, case p when 1 then 'id' when 2 then 'name' when 3 then 'alias' else 'unresolved' end as how from r left join b on b.k = {_KEY.format('ref')} where ref is not null"""


def mentions(s, d):
    q = table(s, d, "qa_dataset").groupBy(F.col("id").alias("question_id")).agg(F.max("question").alias("question"))
    return reason.mentions(q, concepts(s, d))


SEGMENT = "IF(spend > 2000000, 'VIP', IF(spend IS NOT NULL AND n_orders >= 5, 'regular', IF(spend IS NULL, 'none', 'small')))"


def classify_customers(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n_orders"))
    return table(s, d, "customer").join(o, "c_custkey", "left").select("c_custkey", compile_formula(SEGMENT).alias("segment"))


#: Sample triggers and rules.
TRIGGERS = [("purchase_done", "purchase completed"), ("login_error", "error after view"), ("welcome", "signup mail"), ("ad_click", "click on advert")]
RULES = [(1, "如果年消费额 > 100000 且客户已实名，则客户是VIP客户"), (2, "若订单超时并未支付，那么订单取消"), (3, "商品属于类目"), (4, "当库存 < 10 就补货")]
ATOMS = [(1, "body", "VIP客户", ["x"]), (1, "body", "placesOrder", ["x", "y"]), (1, "head", "hasDiscount", ["x"]), (2, "body", "hasDiscount", ["x"]), (2, "head", "VIP客户", ["x"]), (3, "head", "订单", ["z"]), (4, "body", "订单", ["a"]), (4, "head", "取消", ["a", "b"]), (5, "body", "商品", ["q"])]
TYPES = ["VARCHAR(100)", "CHAR(2)", "DECIMAL(10,2)", "TINYINT UNSIGNED", "TINYINT", "DATE", "DATETIME", "TIMESTAMP", "ENUM('a','b')", "BIGINT", "POINT", "BOOLEAN"]
DECISIONS = [("string", False, False, "owl", False), ("int", False, True, "owl", False), ("date", True, True, "neo4j", False), ("Customer", True, False, "owl", False), ("Customer", False, True, "neo4j", False), ("Customer", False, True, "owl", False), ("Customer", False, False, "owl", True), ("Customer", False, False, "owl", False)]
SYNONYMS = [("placesorder", "placesOrder"), ("下单", "placesOrder"), ("ownsorder", "ownsOrder"), ("viewsgoods", "viewsGoods"), ("查看", "viewsGoods")]
COLUMNS = [("product_tag", "product_id", True), ("product_tag", "tag_id", True), ("order_item", "item_id", True), ("order_item", "order_id", False), ("order_item", "product_id", False), ("order_item", "quantity", False), ("follow", "a_id", False), ("follow", "b_id", False), ("follow", "since", False)]
FKS = [("product_tag", "product_id", "product"), ("product_tag", "tag_id", "tag"), ("order_item", "order_id", "order"), ("order_item", "product_id", "product"), ("follow", "a_id", "user"), ("follow", "b_id", "user")]
MESSAGES = [(1, "curator", "broadcast", "added 客户"), (2, "validator", "curator", "check 订单"), (3, "reasoner", "validator", "done"), (4, "validator", "broadcast", "all fine")]


def _values(rows) -> str:
    def v(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "[" + ", ".join(map(v, x)) + "]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(v, r)) + ")" for r in rows) + ")"


def eca_fire(s, d):
    e = table(s, d, "events").groupBy(F.col("event_type").alias("event")).agg(F.count(F.lit(1)).alias("n_events"))
    t = s.createDataFrame(TRIGGERS, "name string, text string")
    return reason.fire(e.select("event", F.col("event").alias("text")), t, 2).join(e, "event")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 1)), lambda i: substring(lower({0}), i, 2)))"
_FIRE = f"""with e as (select event_type as event, count(*) n_events from events group by 1), t as (select * from {_values(TRIGGERS)} v(name, txt))
select e.event, t.name as trigger, n_events from e, t where len(list_intersect({_GRAMS.format('e.event')}, {_GRAMS.format('t.txt')})) >= 2"""


def fk_filter(s, d):
    """Relations taken from foreign keys, checked against the columns that queries use and the names in words."""
    f = relations(s, d).where("source_ref like 'fk:%.%'").select(F.col("relation_id").alias("fk_id"), F.substring_index(F.substring("source_ref", 4, 500), ".", 1).alias("table_name"), F.substring_index("source_ref", ".", -1).alias("column_name"), F.col("name_cn").alias("term"))
    used = table(s, d, "query_log").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit("([a-z_]+)"), F.lit(1)))).alias("column_name")).distinct()
    terms = concepts(s, d).select(F.explode("aliases").alias("term")).unionByName(s.createDataFrame([("承运",), ("下单",), ("查询",)], "term string"))
    return so.fk_filter(f, used, terms, F.col("table_name").rlike("log|audit|session|cache|tmp|backup|temp"))


_FK = _BASE + """, f as (select relation_id fk_id, string_split(substring(source_ref, 4), '.')[1] table_name, string_split(source_ref, '.')[-1] column_name, nullif(name_cn, '') term from rel where source_ref like 'fk:%.%'),
u as (select distinct unnest(regexp_extract_all(lower(sql), '([a-z_]+)', 1)) column_name from query_log), k as (select distinct term from (select unnest(aliases) term from con union all values ('承运'), ('下单'), ('查询'))),
r as (select fk_id, case when regexp_matches(table_name, 'log|audit|session|cache|tmp|backup|temp') then 'rejected' when k.term is not null then 'accepted' when u.column_name is not null then 'needs_review' else 'rejected' end as status from f left join u using (column_name) left join k using (term))
select fk_id, status, case status when 'accepted' then .9 when 'needs_review' then .6 else 0 end as confidence from r"""


def granularity(s, d):
    asked = table(s, d, "query_log").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit("([a-z_]+)"), F.lit(1)))).alias("term"))
    return con.granularity(concepts(s, d), asked, hierarchy.links(table(s, d, "taxonomy_node")).where("parent is not null").select("id"))


_GRAN = _ALL + f""", al as (select {_KEY.format('a')} k, count(distinct id) n, min(id) o from (select id, unnest(aliases) a from con) group by 1), q as (select distinct unnest(regexp_extract_all(lower(sql), '([a-z_]+)', 1)) k from query_log),
c as (select con.id, confidence, coalesce(instance_count, 0) ic, length(regexp_replace(con.name, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) ln, q.k is not null asked, l.parent is not null hint, coalesce(al.n > 1 or (al.n = 1 and al.o <> con.id), false) fr
 from con left join al on al.k = {_KEY.format('con.name')} left join q on q.k = lower(con.name_en) left join l on l.id = con.id),
r as (select id, confidence, case when ic < 3 or (not asked and confidence < .6) then case when hint then 'merge_into_parent' else 'pending' end when ln <= 3 and fr then 'property_value' else 'keep' end as decision from c)
select id, decision, round(case when decision = 'pending' then confidence * .7 else confidence end, 6) as confidence from r"""


def layers(s, d):
    c = concepts(s, d)
    return c.select("id", con.layer(F.col("name"), F.col("name_en"), F.lower(F.trim("source")), F.coalesce(F.col("source_ref").startswith("table:"), F.lit(False))).alias("layer"))


def merged(s, d):
    c = concepts(s, d)
    r = con.representatives(c, con.merge_exact(c))
    return r.withColumn("description", F.coalesce("description", F.lit("")))


_MERGED = _BASE + f""", g as (select {_KEY.format('name')} k, min(id) as component from con where name is not null group by 1), j as (select con.*, component from con join g on g.k = {_KEY.format('con.name')}),
b as (select component, arg_min(name, (-coalesce(confidence, 0), id)) as name, max(confidence) as confidence, arg_min(case when description = chr(1) then '' else description end, (case when description in ('') or description = chr(1) then 1 else 0 end, id)) as description, count(*) as n_members from j group by 1),
o as (select distinct j.component, a from (select component, unnest(list_prepend(name, aliases)) a from j) j join b using (component) where a is not null and a <> '' and a <> b.name)
select component, name, confidence, description, coalesce((select array_to_string(list_sort(list(a)), '|') from o where o.component = b.component), '') as aliases, n_members from b"""


def embedding_neighbors(s, d):
    v = table(s, d, "embeddings")
    n = con.nearest(v, v.where("vec_id % 100 = 0"))
    return n.select("query_id", "vec_id", (F.round("similarity", 4) + 0.0).alias("similarity"))


_NEAR = """with p as (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) s from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by s desc, vec_id) k from p) select query_id, vec_id, round(s, 4) + 0.0 as similarity from r where k <= 10"""

_HASH = """with g as (select id, substring(name, i, 3) g, 1.0::double w from (select id, name, unnest(range(1, length(name) - 1)) i from con) union all select id, substring(name, i, 2), 0.5 from (select id, name, unnest(range(1, length(name))) i from con)),
s as (select id, ('0x' || substring(md5(g), 1, 8))::bigint % 384 as bucket, sum(w) s from g group by 1, 2) select id, bucket, round(s / sqrt(sum(s * s) over (partition by id)), 6) as weight from s"""


def reltype_pairs(s, d):
    e = hierarchy.links(table(s, d, "taxonomy_node")).where("parent is not null")
    c = concepts(s, d)
    j = e.join(c.select("id", F.col("name").alias("a")), "id").join(c.select(F.col("id").alias("parent"), F.col("name").alias("b"), "description"), "parent")
    return j.select("id", "parent", so.relation_kind(F.col("a"), F.col("b"), F.col("description")).alias("kind"))


def fk_inclusion(s, d):
    """Data-driven check of the star schema's keys: values and values without parent."""
    checks = [("lineitem.l_orderkey", "orders", table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), table(s, d, "orders").select(F.col("o_orderkey").alias("k"))), ("lineitem.l_partkey", "part", table(s, d, "lineitem").select(F.col("l_partkey").alias("k")), table(s, d, "part").select(F.col("p_partkey").alias("k"))), ("orders.o_custkey", "customer", table(s, d, "orders").select(F.col("o_custkey").alias("k")), table(s, d, "customer").select(F.col("c_custkey").alias("k")))]
    out = None
    for name, ref, child, parent in checks:
        keys = child.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        j = keys.join(parent.distinct().withColumn("hit", F.lit(1)), "k", "left").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("hit").isNull()).alias("n_missing")).select(F.lit(name).alias("fk"), F.lit(ref).alias("ref_table"), "n_keys", "n_missing")
        out = j if out is None else out.unionByName(j)
    return out


def geo_edges(s, d):
    """Geography as a class hierarchy: customers and suppliers below nations, nations below regions."""
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    a = table(s, d, "nation").select(k("n", "n_nationkey").alias("child"), k("r", "n_regionkey").alias("parent"))
    b = table(s, d, "customer").select(k("c", "c_custkey").alias("child"), k("n", "c_nationkey").alias("parent"))
    c = table(s, d, "supplier").select(k("s", "s_suppkey").alias("child"), k("n", "s_nationkey").alias("parent"))
    return a.unionByName(b).unionByName(c)


def closure_geo(s, d):
    return graph.closure(geo_edges(s, d)).select("child", "ancestor", F.col("distance").cast("bigint").alias("distance"))


def inherited_geo(s, d):
    """Flagship: per customer the relations declared at its region and nation."""
    c = closure_geo(s, d)
    rel = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("ancestor"), F.concat(F.lit("servedBy"), "r_name").alias("rel")).unionByName(table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("ancestor"), F.concat(F.lit("taxedIn"), "n_name").alias("rel")))
    return c.where("child like 'c%'").join(rel, "ancestor").groupBy("child").agg(F.count(F.lit(1)).alias("n_relations"), F.min("distance").alias("nearest"))


_GEO = """with recursive e as (select 'n' || n_nationkey child, 'r' || n_regionkey parent from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
c as (select child, parent ancestor, 1 distance from e union all select c.child, e.parent, c.distance + 1 from c join e on e.child = c.ancestor) """


def swrl_parse(s, d):
    return so.split_rule(s.createDataFrame(RULES, "rule_id bigint, text string")).withColumn("pos", F.col("pos").cast("bigint"))


_ATOMS = f"with a as (select * from {_values(ATOMS)} v(rule_id, part, predicate, variables))"
_RULECHECK = _ATOMS + """, g as (select rule_id, list_distinct(flatten(list(case when part = 'head' then variables else [] end))) h, list_distinct(flatten(list(case when part = 'body' then variables else [] end))) b, count(*) filter (where part = 'head') nh, count(*) filter (where part = 'body') nb from a group by 1)
select rule_id, p as problem from (select rule_id, unnest([case when nh = 0 then 'empty_head' end, case when nb = 0 then 'empty_body' end, case when nb > 0 and len(list_filter(h, lambda x: not list_contains(b, x))) > 0 then 'unbound:' || array_to_string(list_sort(list_filter(h, lambda x: not list_contains(b, x))), ',') end]) p from g) where p is not null"""


def _atoms(s):
    return s.createDataFrame(ATOMS, "rule_id bigint, part string, predicate string, variables array<string>")


def referential_integrity(s, d):
    ids = table(s, d, "onto_concept").select(norm_id("id").alias("id")).where("id is not null").distinct()
    t = table
    return so.dangling({"onto_property": (t(s, d, "onto_property"), ["domain_concept_id"]), "onto_relation": (t(s, d, "onto_relation"), ["domain_concept_id", "range_concept_id"]), "taxonomy_node": (t(s, d, "taxonomy_node"), ["concept_id", "parent_id"])}, ids)


def _dang(e, f):
    return f"select '{e}' as entity, '{f}' as field, count(*) as n from {e} where {_id(f)} is not null and {_id(f)} not in (select {_id('id')} from onto_concept where {_id('id')} is not null) having count(*) > 0"


def build_stats(s, d):
    t = table
    return so.stats({"onto_concept": (t(s, d, "onto_concept"), "source"), "onto_property": (t(s, d, "onto_property"), "value_type"), "onto_relation": (t(s, d, "onto_relation"), "cardinality"), "taxonomy_node": (t(s, d, "taxonomy_node"), "reason"), "change_log": (t(s, d, "change_log"), "op")})


_STATS = " union all ".join(f"select '{e}' as entity, '{c}' as dimension, {_KEY.format(c)} as value, count(*) as n from {e} group by 3" for e, c in (("onto_concept", "source"), ("onto_property", "value_type"), ("onto_relation", "cardinality"), ("taxonomy_node", "reason"), ("change_log", "op")))


def disjoint(s, d):
    """Siblings under the roots said to be disjoint: pairs of parents named by versions of one node."""
    e = table(s, d, "taxonomy_node").select(norm_id("concept_id").alias("child"), norm_id("parent_id").alias("parent")).where("child is not null and parent is not null").distinct()
    pairs = e.groupBy("child").agg(F.min("parent").alias("a"), F.max("parent").alias("b")).where("a < b").select("a", "b").distinct()
    return so.disjoint_violations(e, pairs)


_CHG = "e as (select distinct lower(trim(op)) op, lower(trim(target)) as target, {0} ref, changed_at, change_id from change_log)".format(_id("ref"))


def edit_apply(s, d):
    log = table(s, d, "change_log")
    c = enrich.apply_changes(concepts(s, d).select("id"), "id", log, "concept")
    return c.select("id")


def inbox(s, d):
    return enrich.inbox(s.createDataFrame(MESSAGES, "pos bigint, sender string, recipient string, text string"), "curator")


#: Configured terms of other vocabularies.
MAPPINGS = [("承运商", "schema:Organization"), ("订单", "schema:Order"), ("标签", "schema:DefinedTerm"), ("优惠券", "schema:Coupon"), ("无此词", "schema:Thing")]


def ext_mapping(s, d):
    """Configured terms mapped to the least concept that has them as an alias."""
    terms = concepts(s, d).select(F.explode("aliases").alias("term"), "id").groupBy("term").agg(F.min("id").alias("id"))
    return enrich.external_mapping(s.createDataFrame(MAPPINGS, "term string, uri string"), terms)


def relevance_topk(s, d):
    """Search: the questions whose number is divisible by 100, against all concepts."""
    q = table(s, d, "qa_dataset").where("cast(substring(id, 2) as bigint) % 100 = 0").groupBy(F.col("id").alias("question_id")).agg(F.max("question").alias("question"))
    return context.relevance(q, concepts(s, d))


def relevant_slice(s, d):
    return context.surroundings(relevance_topk(s, d), _closure(s, d)).withColumn("how", F.col("how").cast("bigint"))


#: Configured subjects of the sample.
SUBJECTS = [("管理员", None), ("VIP客户", "普通客户"), ("普通客户", None), ("代理商", "无此人")]


def perm_subjects(s, d):
    return mining.subjects(table(s, d, "documents"), s.createDataFrame(SUBJECTS, "name string, parent string"))


TIMED = [(1, "body", "Order", ["o"]), (1, "body", "swrlb:greaterThan", ["payTime", "limit"]), (1, "head", "Cancelled", ["o"]), (2, "body", "swrlb:greaterThan", ["amount", "limit"]), (2, "head", "Big", ["o"])]
_REL20 = _BASE + """, q as (select id question_id, lower(max(question)) q from qa_dataset where substring(id, 2)::bigint % 100 = 0 group by 1),
x as (select question_id, con.id, (case when length(name) >= 2 and contains(q, lower(name)) then 5 else 0 end + 3 * len(list_filter(aliases, lambda a: length(a) >= 2 and contains(q, lower(a)))) + case when len(list_filter(list_transform(range(1, greatest(length(replace(description, chr(1), '')), 1)), lambda i: substring(lower(replace(description, chr(1), '')), i, 2)), lambda g: contains(q, g))) > 0 then 1 else 0 end) score from q, con),
rel20 as (select question_id, id, score from (select *, row_number() over (partition by question_id order by score desc, id desc) r from x where score > 0) where r <= 20)"""

QUERIES = {
    "relevance_topk": relevance_topk,
    "relevant_slice": relevant_slice,
    "perm_subjects": perm_subjects,
    "triggers_swrl": lambda s, d: mining.triggers_of_rules(s.createDataFrame(TIMED, "rule_id bigint, part string, predicate string, variables array<string>")),
    "closure_geo": closure_geo,
    "inherited_relations_geo": inherited_geo,
    "closure_taxonomy": _closure,
    "is_a_batch": is_a_batch,
    "inherited_relations": _inherited(_facts_rel),
    "inherited_properties": _inherited(_facts_prop),
    "constraint_check": constraint_check,
    "cf_remove_subclass": cf_remove_subclass,
    "cf_add_subclass": cf_add_subclass,
    "cf_remove_relation": cf_remove_relation,
    "cf_remove_concept": cf_remove_concept,
    "describe_concept": describe_concept,
    "resolve_refs": resolve_refs,
    "mentions": mentions,
    "derived_lineage": lambda s, d: reason.lineage(properties(s, d)),
    "classify_customers": classify_customers,
    "eca_fire_events": eca_fire,
    "domain_vote": domain_vote,
    "range_vote": range_vote,
    "infer_axioms": infer_axioms,
    "axiom_risk": axiom_risk,
    "multiple_parents": multiple_parents,
    "consistency_disjoint": disjoint,
    "consistency_rule_vars": lambda s, d: so.check_rules(_atoms(s)),
    "consistency_rule_cycles": lambda s, d: so.rule_cycles(_atoms(s)),
    "referential_integrity": referential_integrity,
    "build_stats": build_stats,
    "swrl_parse": swrl_parse,
    "prop_vs_rel": lambda s, d: s.createDataFrame(DECISIONS, "t string, a boolean, r boolean, dialect string, f boolean").select("t", "a", "r", "dialect", "f", so.property_or_relation(F.col("t"), F.col("a"), F.col("r"), F.col("dialect"), F.col("f")).alias("decision")),
    "valid_types": lambda s, d: s.createDataFrame([(t,) for t in TYPES], "sql_type string").select("sql_type", so.value_type(F.col("sql_type")).alias("value_type"), *so.type_limits(F.col("sql_type"))),
    "fk_filter": fk_filter,
    "fk_relations": lambda s, d: s.createDataFrame(FKS, "table_name string, fk_column string, ref_table string").select("table_name", "fk_column", so.relation_name(F.col("ref_table")).alias("relation_name")),
    "junction_detect": lambda s, d: so.junctions(s.createDataFrame(COLUMNS, "table_name string, column_name string, is_primary_key boolean"), s.createDataFrame(FKS, "table_name string, fk_column string, ref_table string")),
    "reified_concepts": lambda s, d: so.reified_concepts(relations(s, d), concepts(s, d).select("id", "name")),
    "reify_m2m": lambda s, d: so.reify(relations(s, d), concepts(s, d).select("id", "name")),
    "rel_normalize": lambda s, d: so.normalise(relations(s, d), s.createDataFrame(SYNONYMS, "alias string, standard string")),
    "m2m_cardinality": lambda s, d: so.cardinality(table(s, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))),
    "fk_inclusion": fk_inclusion,
    "granularity": granularity,
    "layer_class": layers,
    "identity_spec": lambda s, d: concepts(s, d).where("identity_spec is not null").groupBy("identity_spec").agg(F.count(F.lit(1)).alias("n_concepts")),
    "merge_exact": lambda s, d: con.merge_exact(concepts(s, d)),
    "merge_alias_map": merged,
    "merge_components": lambda s, d: con.merge_similar(concepts(s, d)),
    "embedding_neighbors": embedding_neighbors,
    "hash_embed": lambda s, d: con.hash_embed(concepts(s, d).select("id", F.col("name").alias("text"))),
    "substring_hierarchy": lambda s, d: con.substring_hierarchy(mining.concepts(mining.phrases(table(s, d, "documents").select("doc_id", "text")))),
    "reltype_pairs": reltype_pairs,
    "glossary": lambda s, d: enrich.glossary(s.createDataFrame(SYNONYMS, "alias string, standard string"), concepts(s, d)),
    "ext_mapping": ext_mapping,
    "annotations": lambda s, d: enrich.annotations(table(s, d, "onto_property")),
    "governance": lambda s, d: enrich.governance(table(s, d, "onto_concept"), table(s, d, "onto_property"), table(s, d, "onto_relation")),
    "changelog_summary": lambda s, d: enrich.change_summary(table(s, d, "change_log")),
    "edit_apply": edit_apply,
    "message_inbox": inbox,
}
_OWN = f"(select distinct {_id('domain_concept_id')} id from onto_property)"
_SLICE = _ALL + _REL20[_REL20.index(", q as"):] + """, near as (select anc, id from (select anc, id, row_number() over (partition by anc order by dist, id) r from up where dist > 0) where r <= 5),
every as (select question_id, id, min(how) how from (select question_id, id, 0 how from rel20 union all select question_id, up.anc, 1 from rel20 join up on up.id = rel20.id and up.dist > 0 union all select question_id, near.id, 2 from rel20 join near on near.anc = rel20.id) group by 1, 2),
slice as (select question_id, id, how from (select *, row_number() over (partition by question_id order by how, id) r from every) where r <= 40)"""
_ROLE_SQL = mining.ROLES.replace("'", "''")
ORACLE = {
    "relevance_topk": _REL20 + " select * from rel20",
    "relevant_slice": _SLICE + " select * from slice",
    "perm_subjects": f"with c as (select * from {_values(SUBJECTS)} v(name, parent)), f as (select doc_id, unnest(regexp_extract_all(text, '{_ROLE_SQL}', 1)) name from documents where text is not null) select name, 'config' as origin, case when parent in (select name from c) then parent end as parent, 0 as n_docs from c union all select name, 'text', null, count(distinct doc_id) from f where length(name) between 2 and 10 and name not in (select name from c) group by 1",
    "triggers_swrl": f"with a as (select *, predicate || '(' || array_to_string(vars, ', ') || ')' x from {_values(TIMED)} v(rule_id, part, predicate, vars)) select rule_id, 'time_based' as event_type, array_to_string(list_sort(list(x) filter (where part = 'body')), ' AND ') as condition_expression, array_to_string(list_sort(list(x) filter (where part = 'head')), ' AND ') as action_detail from a group by rule_id having bool_or(part = 'body' and predicate in ('swrlb:greaterThan', 'swrlb:lessThan') and len(list_filter(vars, lambda v: regexp_matches(lower(v), 'time|date'))) > 0)",
    "closure_geo": _GEO + "select child, ancestor, min(distance) as distance from c group by 1, 2",
    "inherited_relations_geo": _GEO + "select c.child, count(*) as n_relations, min(distance) as nearest from c join (select 'r' || r_regionkey a from region union all select 'n' || n_nationkey from nation) r on r.a = c.ancestor where c.child like 'c%' group by 1",
    "closure_taxonomy": _ALL + "select id as descendant, anc as ancestor, dist as distance from up where dist > 0",
    "is_a_batch": _ALL + "select distinct r.domain as child, r.range as parent, case when a.id is not null and b.id is not null then u.id is not null end as answer, u.dist as distance from rel r left join t a on a.id = r.domain left join t b on b.id = r.range left join up u on u.id = r.domain and u.anc = r.range where r.domain is not null and r.range is not null",
    "inherited_relations": _inherited_sql("(select domain as owner, name fact from rel where domain is not null)"),
    "inherited_properties": _inherited_sql("(select owner, name fact from prop where owner <> '')"),
    "constraint_check": _ALL + """, tri as (select 'd' || r.name predicate, t.root cls from rel r join t on t.id = r.domain union all select 'r' || r.name, t.root from rel r join t on t.id = r.range), """ + _VOTE + """, w as (select predicate, case when share >= .8 then w end w from vote),
x as (select relation_id, case when d.w is null or t1.id is null or t3.id is null then true else coalesce(u1.id is not null, false) end domain_ok, case when r2.w is null or t2.id is null or t4.id is null then true else coalesce(u2.id is not null, false) end range_ok
 from rel r left join w d on d.predicate = 'd' || r.name left join w r2 on r2.predicate = 'r' || r.name left join t t1 on t1.id = r.domain left join t t2 on t2.id = r.range left join t t3 on t3.id = d.w left join t t4 on t4.id = r2.w left join up u1 on u1.id = r.domain and u1.anc = d.w left join up u2 on u2.id = r.range and u2.anc = r2.w
 where r.name in (select substring(predicate, 2) from w))
select relation_id, domain_ok, range_ok, case when domain_ok and range_ok then 1.0 else .3 end as confidence from x""",
    "cf_remove_subclass": _ALL + "select t.id as child, t.parent, t.depth as lost_ancestors, sz.n as affected from t join sz using (id) where t.parent is not null",
    "cf_add_subclass": _ALL + ", q as (select distinct domain as child, range as parent from rel where domain is not null and range is not null and domain <> range) select q.child, q.parent, case when a.id is null or b.id is null then 'unknown' when u.id is not null then 'already' when v.id is not null then 'cycle' else 'gains' end as outcome, case when a.id is not null and b.id is not null and u.id is null and v.id is null then b.depth + 1 else 0 end as gained from q left join t a on a.id = q.child left join t b on b.id = q.parent left join up u on u.id = q.child and u.anc = q.parent left join up v on v.id = q.parent and v.anc = q.child",
    "cf_remove_relation": _ALL + ", f as (select distinct domain o, name fact from rel where domain in (select id from t)) select fact, count(distinct o) as n_direct, count(distinct up.id) as n_affected from f join up on up.anc = f.o group by 1",
    "cf_remove_concept": _ALL + "select con.id, (select count(*) from l where l.parent = con.id) as orphan_children, (select count(*) from rel where rel.domain = con.id or rel.range = con.id) as broken_relations, (select count(*) from prop where prop.owner = con.id) as lost_properties from con where con.id is not null",
    "describe_concept": _ALL + ", p as (select owner id, array_to_string(list_sort(list_distinct(list(name))), '|') p from prop group by 1), r as (select domain id, array_to_string(list_sort(list_distinct(list(name))), '|') r from rel group by 1) select con.id, con.name, t.depth, sz.n - 1 as n_descendants, coalesce(p, '') as properties, coalesce(r, '') as relations from con left join t using (id) left join sz using (id) left join p using (id) left join r using (id)",
    "resolve_refs": _RESOLVE,
    "mentions": _BASE + ", q as (select id question_id, lower(max(question)) q from qa_dataset group by 1), n as (select lower(name) k, min(name) as name from con where length(name) >= 2 group by 1) select question_id, arg_min(name, (-length(name), name)) as name from q join n on contains(q.q, n.k) group by 1",
    "derived_lineage": _BASE + ", u as (select distinct id, owner, unnest(regexp_extract_all(lower(formula), '([a-z_][a-z0-9_]*)', 1)) s from prop where formula <> '' and owner <> '') select u.id as property_id, s as source_name, count(distinct p.id) as n_sources from u join prop p on p.owner = u.owner and lower(p.name) = s group by 1, 2",
    "classify_customers": "select c_custkey, case when spend > 2000000 then 'VIP' when spend is not null and n_orders >= 5 then 'regular' when spend is null then 'none' else 'small' end as segment from customer left join (select o_custkey c_custkey, sum(o_totalprice) spend, count(*) n_orders from orders group by 1) using (c_custkey)",
    "eca_fire_events": _FIRE,
    "domain_vote": _BASE + ", tri as (select rel.name predicate, lower(trim(con.source)) cls from rel left join con on con.id = rel.domain where rel.domain is not null), " + _VOTE + _VOTED,
    "range_vote": _BASE + ", tri as (select name predicate, value_type cls from prop), " + _VOTE + _VOTED,
    "infer_axioms": _BASE + ", tri as (select 'domain|' || rel.name predicate, lower(trim(con.source)) cls from rel left join con on con.id = rel.domain where rel.domain is not null union all select 'range|' || name, value_type from prop), " + _VOTE + "select string_split(predicate, '|')[1] as axiom_type, string_split(predicate, '|')[2] as subject, w as object, round(share, 6) as share from vote where share >= .95",
    "axiom_risk": f"with n as (select {_id('concept_id')} id, coalesce({_id('parent_id')}, '') p, confidence, updated_at from taxonomy_node), e as (select id, arg_max(p, (updated_at, p, confidence)) p, arg_max(confidence, (updated_at, p, confidence)) c from n where id is not null group by 1) select id, 'medium' as risk, case when c < .7 then 'rejected' when c >= .9 then 'auto' else 'review' end as status from e where p <> ''",
    "multiple_parents": _ALL + f", e as (select distinct {_id('concept_id')} child, {_id('parent_id')} parent from taxonomy_node) select child, count(*) as n_parents, count(distinct t.root) as n_roots from e join t on t.id = e.parent where child is not null group by 1 having count(*) > 1 and count(distinct t.root) > 1",
    "consistency_disjoint": f"with e as (select distinct {_id('concept_id')} child, {_id('parent_id')} parent from taxonomy_node where {_id('concept_id')} is not null and {_id('parent_id')} is not null), p as (select distinct a, b from (select child, min(parent) a, max(parent) b from e group by 1) where a < b) select a, b, x.child from p join e x on x.parent = a join e y on y.parent = b and y.child = x.child",
    "consistency_rule_vars": _RULECHECK,
    "consistency_rule_cycles": _ATOMS + ", f as (select distinct h.rule_id a, b.rule_id b from a h join a b on h.predicate = b.predicate and h.part = 'head' and b.part = 'body' and h.rule_id <> b.rule_id) select f.a, f.b from f join f g on f.a = g.b and f.b = g.a",
    "referential_integrity": " union all ".join(_dang(e, f) for e, f in (("onto_property", "domain_concept_id"), ("onto_relation", "domain_concept_id"), ("onto_relation", "range_concept_id"), ("taxonomy_node", "concept_id"), ("taxonomy_node", "parent_id"))),
    "build_stats": _STATS,
    "swrl_parse": f"with r as (select *, string_split(regexp_replace(txt, '则|那么|就', chr(1)), chr(1)) p from {_values(RULES)} v(rule_id, txt)), a as (select rule_id, case when len(p) = 2 then list_append(list_transform(list_filter(list_transform(string_split_regex(regexp_replace(trim(p[1]), '^如果|^若|^当', ''), '且|并|and|AND'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {{'kind': case when regexp_matches(x, '[<>=]') then 'comparison' else 'class_membership' end, 't': x}}), {{'kind': 'conclusion', 't': trim(p[2])}}) else [{{'kind': 'relation', 't': txt}}] end l from r) select rule_id, i - 1 as pos, l[i].kind as kind, l[i].t as text from (select *, unnest(range(1, len(l) + 1)) i from a)",
    "prop_vs_rel": f"select *, case when lower(t) in ({', '.join(repr(x) for x in so.LITERALS)}) then case when r and dialect = 'owl' then 'relation' else 'property' end when a then 'relation' when r then case when dialect = 'owl' then 'relation' else 'property' end when f then 'relation' else 'property' end as decision from {_values(DECISIONS)} v(t, a, r, dialect, f)",
    "valid_types": f"select t as sql_type, case when contains(lower(t), 'int') then 'int' when regexp_matches(lower(t), 'decimal|float|double') then 'float' when regexp_matches(lower(t), 'date|time') then 'date' when contains(lower(t), 'enum') then 'enum' when contains(lower(t), 'bool') then 'bool' else 'string' end as value_type, nullif(regexp_extract(t, '^(?:VAR)?CHAR\\((\\d+)\\)', 1), '')::bigint as max_length, case when contains(t, 'TINYINT UNSIGNED') then 255.0 when contains(t, 'TINYINT') then 127.0 when t like 'DECIMAL%' then 99999999.99 end as max_value, case when contains(t, 'TINYINT UNSIGNED') then 0.0 when contains(t, 'TINYINT') then -128.0 end as min_value, case when contains(t, 'DATE') and not contains(t, 'TIME') then 'yyyy-MM-dd' when regexp_matches(t, 'DATETIME|TIMESTAMP') then 'yyyy-MM-dd HH:mm:ss' end as format from {_values([(t,) for t in TYPES])} v(t)",
    "fk_filter": _FK,
    "fk_relations": f"select t as table_name, c as fk_column, 'has' || upper(substring(r, 1, 1)) || lower(substring(r, 2)) as relation_name from {_values(FKS)} v(t, c, r)",
    "junction_detect": f"with c as (select * from {_values(COLUMNS)} v(t, c, pk)), f as (select * from {_values(FKS)} v(t, c, r)), g as (select t, list(r order by c, r) r, bool_and((t, c) in (select (t, c) from c where pk)) inpk from f group by t having count(*) = 2) select t as table_name, r[1] as a, r[2] as b from g where inpk or (select count(*) from c where c.t = g.t) <= 3",
    "reify_m2m": _BASE + ", j as (select rel.*, a.name an, b.name bn from rel left join con a on a.id = rel.domain left join con b on b.id = rel.range), s as (select *, cardinality = 'N:M' and an is not null and bn is not null split, an || '_' || bn || '_Relation' mid from j), m as (select *, 'concept_' || substring(sha256(mid), 1, 8) mi from s) select relation_id, name, domain, range, cardinality from m where split is not true union all select relation_id || '/1', 'has' || mid, domain, mi, '1:N' from m where split union all select relation_id || '/2', 'refersTo' || bn, mi, range, '1:N' from m where split",
    "reified_concepts": _BASE + "select 'concept_' || substring(sha256(mid), 1, 8) as id, min(mid) as name, .8::double as confidence, count(*) as n_relations from (select a.name || '_' || b.name || '_Relation' mid from rel join con a on a.id = rel.domain join con b on b.id = rel.range where cardinality = 'N:M') where mid is not null group by 1",
    "rel_normalize": _BASE + f", y as (select * from {_values(SYNONYMS)} v(alias, standard)), j as (select coalesce(standard, rel.name) std, rel.domain, rel.range, confidence, list_concat(aliases, case when coalesce(standard, rel.name) <> rel.name then [rel.name] else [] end) al from rel left join y on y.alias = lower(rel.name)) select std as name, domain, range, max(confidence) as confidence, array_to_string(list_sort(list_distinct(flatten(list(al)))), '|') as aliases, count(*) as n from j group by 1, 2, 3",
    "m2m_cardinality": "with p as (select distinct l_partkey a, l_suppkey b from lineitem), x as (select max(n) x from (select count(*) n from p group by a)), y as (select max(n) y from (select count(*) n from p group by b)) select x as max_b_per_a, y as max_a_per_b, case when y > 1 then 'N' else '1' end || ':' || case when x > 1 then case when y > 1 then 'M' else 'N' end else '1' end as cardinality from x, y",
    "fk_inclusion": "select 'lineitem.l_orderkey' as fk, 'orders' as ref_table, count(distinct l_orderkey) as n_keys, count(distinct case when l_orderkey not in (select o_orderkey from orders) then l_orderkey end) as n_missing from lineitem union all select 'lineitem.l_partkey', 'part', count(distinct l_partkey), count(distinct case when l_partkey not in (select p_partkey from part) then l_partkey end) from lineitem union all select 'orders.o_custkey', 'customer', count(distinct o_custkey), count(distinct case when o_custkey not in (select c_custkey from customer) then o_custkey end) from orders",
    "granularity": _GRAN,
    "layer_class": _BASE + f"select id, case when lower(trim(source)) = 'rdb' and source_ref like 'table:%' then 'data' when regexp_matches(concat_ws(' ', lower(name), lower(name_en)), '{con.LOGIC}') then 'logic' when regexp_matches(concat_ws(' ', lower(name), lower(name_en)), '{con.APPLICATION}') then 'application' when lower(trim(source)) = 'text' then 'logic' else 'data' end as layer from con",
    "identity_spec": f"select identity_spec, count(*) as n_concepts from (select {_id('id')} id, arg_max(coalesce(identity_spec, ''), loaded_at) identity_spec from onto_concept where id is not null group by 1) where identity_spec <> '' group by 1",
    "merge_exact": _BASE + f"select min(id) over (partition by {_KEY.format('name')}) as component, id from con where name is not null",
    "merge_alias_map": _MERGED,
    "embedding_neighbors": _NEAR,
    "hash_embed": f"with {_CON}, " + _HASH[5:],
    "substring_hierarchy": f"with n as (select term as name, sum(n)::bigint n from ({_PHRASES}) group by term) select c.name as child, p.name as parent, .6 as confidence from n c join n p on contains(c.name, p.name) and c.name <> p.name and c.n < p.n where p.name <> ''",
    "reltype_pairs": _ALL + f"select l.id, l.parent, case when contains(a.name, b.name) or contains(b.name, a.name) then 'is-a' when regexp_matches(replace(b.description, chr(1), ''), '{so.PART_OF}') then 'part-of' else 'related-to' end as kind from l join con a on a.id = l.id join con b on b.id = l.parent",
    "glossary": _BASE + f", y as (select * from {_values(SYNONYMS)} v(alias, standard)), g as (select standard term, 'config' origin, array_to_string(list_sort(list_distinct(list(alias))), '|') synonyms from y group by 1) select * from g union all select distinct regexp_replace(name, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') t, 'concept', '' from con where t <> '' and t not in (select term from g)",
    "ext_mapping": _BASE + f", m as (select * from {_values(MAPPINGS)} v(term, uri)), k as (select a, min(id) id from (select id, unnest(aliases) a from con) group by 1) select term, uri, coalesce(k.id, term) as target from m left join k on k.a = m.term",
    "annotations": "select string_split(source_ref, '.')[1] as table_name, string_split(source_ref, '.')[-1] as column_name, min(name_cn) as annotation from onto_property where source_ref like '%.%' and name_cn is not null and trim(name_cn) <> '' group by 1, 2",
    "governance": f"with c as (select {_id('id')} id, max((regexp_replace(coalesce(description, ''), '[\\s\\p{{Z}}]', '', 'g') <> '')::int) d from onto_concept where {_id('id')} is not null group by 1), r as (select {_id('domain_concept_id')} id from onto_relation union select {_id('range_concept_id')} from onto_relation), n as (select count(*) n, sum(1 - d) a, count(*) filter (where id not in (select id from {_OWN} where id is not null)) b, count(*) filter (where id not in (select id from r where id is not null)) e from c) select 'description' as rule, n as n_checked, a::bigint as n_broken from n union all select 'property', n, b from n union all select 'orphan', n, e from n union all select 'relation_description', count(*), count(*) filter (where coalesce(trim(w), '') = '') from (select id, max(name_cn) w from onto_relation group by 1)",
    "changelog_summary": f"with e as (select distinct lower(trim(op)) op, lower(trim(target)) as target, {_id('ref')} ref, changed_at from change_log) select op, target, count(*) as n from e group by 1, 2",
    "edit_apply": f"with {_CON}, {_CHG}, g as (select ref from e where target = 'concept' and op in ('create', 'delete') and ref is not null group by ref having arg_max(op, (changed_at, change_id)) = 'delete') select id from con where id not in (select ref from g)",
    "message_inbox": f"select * from {_values(MESSAGES)} v(pos, sender, recipient, text) where recipient = 'curator' or (recipient = 'broadcast' and sender <> 'curator')",
}
