"""Queries on relational schemas and files: DDL written from the ontology's tables, scanned again and turned into concepts, properties and relations; saved ontologies; checks and reports; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ontoloom import pipeline
from ontoloom.editing import Editor, scenario
from ontoloom.functions.ids import norm_id
from ontoloom.operators import graph, hierarchy, linkage, mining, profile, querylog
from ontoloom.operators import schema_ops as so
from ontoloom.plans.reasoning import _ALL, _BASE, _values, concepts, properties, relations
from ontoloom.plans.records import _P6, _P6_FOUND, _id
from ontoloom.plans.tables import _CLEAN, _CRUD, _TAB
from ontoloom.plans.texts import _HEARST
from ontoloom.session import app_folder, cut, once, table
from ontoloom.sources import ddl, files, views


def _place(s, name: str) -> str:
    return f"{app_folder(s)}/{name}-{uuid.uuid4().hex}"


def rdb(s, d):
    """Tables, columns and foreign keys of the concepts that a table stands for: columns are a key of its own, its properties and its relations to other tables; a table with relations only has them as its key."""
    t = concepts(s, d).where("source_ref like 'table:%'").groupBy(F.substring("source_ref", 7, 1000).alias("table_name")).agg(F.min(F.struct("id", "description")).alias("v")).select("table_name", F.col("v.id").alias("cid"), F.coalesce("v.description", F.lit("")).alias("comment"))
    p = properties(s, d).where("owner is not null").join(t.select(F.col("cid").alias("owner"), "table_name"), "owner").groupBy("table_name", "name").agg(F.max("value_type").alias("vt"), F.coalesce(F.max("name_cn"), F.lit("")).alias("comment"))
    kind = F.when(F.col("vt") == "int", "BIGINT").when(F.col("vt") == "float", "DECIMAL(10,2)").when(F.col("vt") == "date", "DATETIME").otherwise("VARCHAR(64)")
    ends = t.select(F.col("cid").alias("range"), F.col("table_name").alias("ref_table"))
    fk = relations(s, d).join(t.select(F.col("cid").alias("domain"), "table_name"), "domain").join(ends, "range").groupBy("table_name", F.concat(F.lower("name"), F.lit("_id")).alias("fk_column")).agg(F.min("ref_table").alias("ref_table"))
    has = t.join(p.select("table_name").distinct().withColumn("p", F.lit(True)), "table_name", "left").join(fk.select("table_name").distinct().withColumn("k", F.lit(True)), "table_name", "left").select("table_name", (F.col("p").isNull() & F.col("k").isNotNull()).alias("bare"))
    own = has.where("not bare").select("table_name", F.lit(0).alias("o"), F.lit("id").alias("column_name"), F.lit("BIGINT").alias("sql_type"), F.lit("").alias("comment"), F.lit(True).alias("is_primary_key"))
    plain = p.select("table_name", F.lit(1).alias("o"), F.col("name").alias("column_name"), kind.alias("sql_type"), "comment", F.lit(False).alias("is_primary_key"))
    keys = fk.join(has, "table_name").select("table_name", F.lit(2).alias("o"), F.col("fk_column").alias("column_name"), F.lit("BIGINT").alias("sql_type"), F.lit("").alias("comment"), F.col("bare").alias("is_primary_key"))
    return t, own.unionByName(plain).unionByName(keys), fk


_RDB = (
    _BASE
    + """, tb as (select substring(source_ref, 7) table_name, min(id) cid, coalesce(nullif(arg_min(description, id), chr(1)), '') as comment from con where source_ref like 'table:%' group by 1),
pr as (select table_name, name, max(value_type) vt, max(cn) as comment from (select p.name, p.value_type, c.cn, tb.table_name from (select id, arg_max(coalesce(name_cn, ''), loaded_at) cn from onto_property group by 1) c join prop p using (id) join tb on tb.cid = p.owner) group by 1, 2),
fk as (select a.table_name, lower(r.name) || '_id' fk_column, min(b.table_name) ref_table from rel r join tb a on a.cid = r.domain join tb b on b.cid = r.range group by 1, 2),
bare as (select table_name, table_name not in (select table_name from pr) and table_name in (select table_name from fk) bare from tb),
cols as (select table_name, 0 o, 'id' column_name, 'BIGINT' sql_type, '' as comment, true is_primary_key from bare where not bare union all select table_name, 1, name, case vt when 'int' then 'BIGINT' when 'float' then 'DECIMAL(10,2)' when 'date' then 'DATETIME' else 'VARCHAR(64)' end, comment, false from pr
 union all select fk.table_name, 2, fk_column, 'BIGINT', '', bare from fk join bare using (table_name)) """
)


def parsed(s, d):
    """The schema's statements written to files and scanned from there, once for all queries."""

    def build(_):
        t, columns, fks = rdb(s, d)
        path = _place(s, "ddl")
        ddl.statements(t, columns, fks).select("statement").write.text(path)
        return ddl.scan(s, path)

    return once(f"ddl:{d}", table(s, d, "onto_concept"), build)


def ddl_tables(s, d):
    return parsed(s, d).select("table_name", "comment", F.size("columns").cast("bigint").alias("n_columns"), F.size("foreign_keys").cast("bigint").alias("n_fks"))


def ddl_columns(s, d):
    return ddl.columns(parsed(s, d)).select("table_name", F.col("pos").cast("bigint").alias("pos"), "column_name", "sql_type", "comment", "is_primary_key")


def ddl_fks(s, d):
    return ddl.foreign_keys(parsed(s, d)).select("table_name", "fk_column", "ref_table", "ref_column")


def rdb_concepts(s, d):
    return pipeline.table_concepts(parsed(s, d)).select("name", F.col("name_en").alias("table_name"), "confidence")


def ddl_properties(s, d):
    t = parsed(s, d)
    c = t.select(F.col("table_name").alias("id"), "table_name").distinct()
    return pipeline.column_properties(ddl.columns(t), ddl.foreign_keys(t), c).select(F.col("domain_concept_id").alias("table_name"), "name", "value_type", "source_ref", "confidence")


def identity_of_tables(s, d):
    return pipeline.identity(ddl.columns(parsed(s, d))).select("table_name", "identity_spec")


def junction_relations(s, d):
    """Each many-to-many relation written as a link table of its ends, and read back as a relation."""
    r = relations(s, d).where("cardinality = 'N:M' and domain is not null and range is not null").select(F.concat(F.lit("link_"), "relation_id").alias("table_name"), F.concat(F.lit("of_"), "domain").alias("a"), F.concat(F.lit("of_"), "range").alias("b"))
    texts = r.select(F.col("table_name").alias("source"), F.format_string("CREATE TABLE `%s` (a_id BIGINT, b_id BIGINT, since DATETIME, PRIMARY KEY (a_id, b_id), FOREIGN KEY (a_id) REFERENCES `%s` (id), FOREIGN KEY (b_id) REFERENCES `%s` (id));", "table_name", "a", "b").alias("text"))
    t = cut(ddl.tables(texts))
    c = r.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("table_name"))
    return pipeline.junction_relations(ddl.columns(t), ddl.foreign_keys(t), c).select("name", "domain", "range", "cardinality", "confidence")


def log_scan(s, d):
    """The query log written as JSON lines and scanned as a log."""

    def build(log):
        path = _place(s, "log")
        log.where("sql is not null").select("sql", "frequency", "app_key").write.json(path)
        return files.query_log(s, path)

    return once("log_scan", table(s, d, "query_log"), build).groupBy("sql", "frequency").agg(F.count(F.lit(1)).alias("n_rows"))


def _kinds(s, d):
    return {"concepts": concepts(s, d).select("id", "name", "source"), "properties": properties(s, d).select("id", "name", F.col("owner").alias("domain"), "value_type"), "relations": relations(s, d).select(F.col("relation_id").alias("id"), "name", "domain", "range")}


def _counts(tables, form: str):
    out = None
    for k, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("name").alias("n_named")).select(F.lit(k).alias("kind"), F.lit(form).alias("form"), "n_rows", "n_named")
        out = part if out is None else out.unionByName(part)
    return out


def saved_ontology(s, d):
    """Saved as tables and as JSON, and loaded from both."""
    path = _place(s, "ontology")
    files.save_ontology(_kinds(s, d), path)
    loaded = files.load_ontology(s, path)
    files.export_json(loaded, f"{path}-json")
    again = files.load_json(s, f"{path}-json")
    return _counts(loaded, "tables").unionByName(_counts(again, "json"))


_SAVED = _BASE + ", k as (select 'concepts' kind, count(*) n, count(name) m from con union all select 'properties', count(*), count(name) from prop union all select 'relations', count(*), count(name) from rel) select kind, form, n as n_rows, m as n_named from k, (values ('tables'), ('json')) f(form)"


def edited_ontology(s, d):
    """An editing session on all tables, saved with its log: a concept, a relation, a property and an axiom are created, a relation renamed, the first concept with relations deleted with all that refers to it, and the axiom deleted."""
    t = {k: cut(v) for k, v in _kinds(s, d).items()}
    t["axioms"] = s.createDataFrame([], "id string, axiom_type string, subject string, object string, confidence double")
    e = Editor(s, t)
    known = e.tables["concepts"].select(F.col("id").alias("domain"))
    last = known.agg(F.max("domain")).first()[0]
    gone = e.tables["relations"].join(known, "domain").agg(F.min("domain")).first()[0]
    first = e.tables["relations"].agg(F.min("id")).first()[0]
    e.create("concepts", id="concept_new", name="新概念", source="text")
    e.create("relations", id="rel_new", name="新关系", domain="concept_new", range=last)
    e.update("relations", first, name="改名")
    e.create("properties", id="prop_new", name="新属性", domain="concept_new", value_type="int")
    e.create("axioms", id="axiom_new", axiom_type="subClassOf", subject="concept_new", object=last, confidence=1.0)
    e.delete("concepts", gone)
    e.delete("axioms", "axiom_new")
    path = _place(s, "edited")
    e.save(path)
    saved = files.load_ontology(s, path)
    rows = _counts({k: saved[k] for k in ("concepts", "properties", "relations")}, "saved").drop("form")
    log = s.read.parquet(f"{path}/change_log").groupBy(F.concat_ws(":", F.lit("log"), "op", "target").alias("kind")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_named", F.lit(0).cast("bigint"))
    return rows.unionByName(log)


_EDITED = _BASE + """, g as (select min(domain) id from rel where domain in (select id from con)), k as (select 'concepts' kind, count(*) n, count(name) m from (select id, name from con where id <> (select id from g) union all select 'x', 'x')
 union all select 'properties', count(*), count(name) from (select id, name from prop where owner <> (select id from g) union all select 'x', 'x')
 union all select 'relations', count(*), count(name) from (select relation_id, case when relation_id = (select min(relation_id) from rel) then 'x' else name end as name from rel where coalesce(domain <> (select id from g), true) and coalesce(range <> (select id from g), true) union all select 'x', 'x'))
select kind, n as n_rows, m as n_named from k union all select * from (values ('log:create:axioms', 1, 0), ('log:create:concepts', 1, 0), ('log:create:properties', 1, 0), ('log:create:relations', 1, 0), ('log:delete:axioms', 1, 0), ('log:delete:concepts', 1, 0), ('log:update:relations', 1, 0)) v"""


def mermaid_classes(s, d):
    """All lines of the taxonomy's class diagram."""
    l = hierarchy.links(table(s, d, "taxonomy_node")).where("parent is not null")
    return views.class_lines(l.select(F.col("id").alias("child"), "parent"))


def schema_check(s, d):
    c, p, r = table(s, d, "onto_concept"), table(s, d, "onto_property"), table(s, d, "onto_relation")
    return views.schema_violations(c, "concepts").unionByName(views.schema_violations(p, "properties")).unionByName(views.schema_violations(r, "relations"))


_SCHEMA = "select * from (" + " union all ".join(f"select '{k}' as kind, '{f}' as field, count(*) filter (where {f} is null) as n from {t}" for k, t, fs in (("concepts", "onto_concept", ("id", "name")), ("properties", "onto_property", ("id", "name", "value_type")), ("relations", "onto_relation", ("id", "name"))) for f in fs) + f" union all select 'properties', 'value_type:enum', count(*) filter (where value_type not in ({', '.join(repr(v) for v in views.VALUE_TYPES)})) from onto_property)"

_USABLE = ["name_cn", "source_ref", "value_type", "derivation_formula", "domain_concept_id"]


def usable_columns(s, d):
    return profile.usable_columns(table(s, d, "onto_property"), _USABLE)


_USABLE_SQL = "with r as (" + " union all ".join(f"select '{c}' as column_name, avg(({c} is null)::int) r from onto_property" for c in _USABLE) + "), v as (" + " union all ".join(f"select '{c}' as column_name, {c} as value from onto_property" for c in _USABLE) + "), n as (select column_name, value, count(*) n from v where value is not null group by all), t as (select column_name, arg_min(value, (-n, value)) as modal_value, max(n)::double / sum(n) share from n group by 1) select column_name, case when r > .3 then 'low_confidence' else 'normal' end as triage, modal_value, round(share, 6) as share, share >= .95 as skewed from t join r using (column_name) where r <= .5"

#: Names of columns that bridge systems, by kind.
BRIDGES = [("phone", "phone"), ("email", "email"), ("external_id", "customer_id"), ("external_id", "sku_code"), ("credit_code", "tax_no"), ("external_id", "no_such_column")]


def bridge_fields(s, d):
    """Columns that the sources' concepts have, where at least two sources hold a kind of bridge."""
    src = table(s, d, "onto_concept").groupBy(norm_id("id").alias("owner")).agg(F.max_by(norm_id("source"), F.struct("loaded_at", norm_id("source"))).alias("system"))
    c = properties(s, d).join(src, "owner").select("system", F.col("name").alias("column_name"))
    return linkage.bridge_fields(c, s.createDataFrame(BRIDGES, "bridge_type string, column_name string"))


_BRIDGES = f"with o as (select {_id('id')} owner, arg_max({_id('source')}, (loaded_at, {_id('source')})) as system from onto_concept group by 1), p as (select id, arg_max(coalesce({_id('domain_concept_id')}, ''), loaded_at) as owner, arg_max(name, loaded_at) as name from onto_property group by id), h as (select distinct bridge_type, system, p.name from p join o using (owner) join {_values(BRIDGES)} b(bridge_type, column_name) on b.column_name = lower(p.name) where system is not null) select bridge_type, count(distinct system) as n_systems, array_to_string(list_sort(list(system || '.' || name)), '|') as fields from h group by 1 having count(distinct system) >= 2"


def ddl_completion(s, d):
    """Comments of uncommented columns: the longest that any column of the name has stands for a model's guess, the least for the dictionary's entry."""
    p = table(s, d, "onto_property").where("source_ref like '%.%'").select(F.substring_index("source_ref", ".", 1).alias("table_name"), F.substring_index("source_ref", ".", -1).alias("column_name"), F.nullif(F.trim("name_cn"), F.lit("")).alias("comment"))
    cols = p.groupBy("table_name", "column_name").agg(F.min(F.coalesce("comment", F.lit(""))).alias("comment"))
    known = p.where("comment is not null").groupBy("column_name").agg(F.max_by("comment", F.struct(F.length("comment"), F.col("comment"))).alias("guess"), F.min("comment").alias("comment"))
    guesses = cols.join(known, "column_name").select("table_name", "column_name", F.col("guess").alias("comment"))
    return mining.complete_comments(cols, guesses, known.select("column_name", "comment"))


_COMPLETE = """with p as (select string_split(source_ref, '.')[1] table_name, string_split(source_ref, '.')[-1] column_name, nullif(trim(name_cn), '') c from onto_property where source_ref like '%.%'),
k as (select table_name, column_name, min(coalesce(c, '')) as comment from p group by 1, 2), g as (select column_name, arg_max(c, (length(c), c)) guess, min(c) known from p where c is not null group by 1),
x as (select k.*, guess, known, list_distinct(string_split(guess, '')) a, list_distinct(string_split(known, '')) b from k left join g using (column_name))
select table_name, column_name, case when comment <> '' then comment else coalesce(guess, '') end as comment, case when comment <> '' then 1.0 when guess is null then 0.0 when len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) > .7 then .9 else .3 end::double as confidence from x"""


def taxonomy_attach(s, d):
    """Is-a links mined from texts, where the child has no parent yet."""
    l = hierarchy.links(table(s, d, "taxonomy_node")).where("parent is not null")
    c = concepts(s, d)
    base = l.join(c.select("id", F.col("name").alias("child")), "id").join(c.select(F.col("id").alias("parent"), F.col("name").alias("above")), "parent").select("child", F.col("above").alias("parent"))
    docs = table(s, d, "documents").select("doc_id", "text")
    return graph.attach(base, mining.hearst(docs).select("child", "parent", "confidence"))


def cycle_removed(s, d):
    """Edges taken out to make the latest taxonomy acyclic."""
    n = table(s, d, "taxonomy_node").withColumn("child", norm_id("concept_id"))
    e = n.where("child is not null").groupBy("child").agg(F.max_by(F.struct(norm_id("parent_id").alias("parent"), "confidence"), F.struct("updated_at", norm_id("parent_id"), "confidence")).alias("v")).select("child", "v.parent", "v.confidence")
    return graph.remove_cycles(e)[1]


_CYCLE_REMOVED = _P6_FOUND[: _P6_FOUND.index("select id as concept_id, 'tree'")] + f""", n as (select {_id('concept_id')} id, coalesce({_id('parent_id')}, '') p, confidence, updated_at from taxonomy_node), c as (select id, arg_max(coalesce(confidence, .5), (updated_at, p, confidence)) c from n where id is not null group by 1),
r as (select start id, list_min(path) root from e where k = 1) select arg_min(r.id, (c, r.id)) as child, arg_min(l.parent, (c, r.id)) as parent, min(c) as confidence from r join c using (id) join l using (id) group by root"""


def topo_levels(s, d):
    """Level of each node of the latest taxonomy that no cycle is above."""
    l = hierarchy.links(table(s, d, "taxonomy_node")).where("parent is not null")
    return graph.levels(l.select(F.col("id").alias("child"), "parent")).withColumn("level", F.col("level").cast("bigint"))


def rule_bindings(s, d):
    """Conditions of all questions that are rules in words, bound to concepts."""
    q = table(s, d, "qa_dataset").groupBy("id").agg(F.max("question").alias("text")).select(F.col("id").alias("rule_id"), "text")
    return so.bind(so.split_rule(q), concepts(s, d)).withColumn("pos", F.col("pos").cast("bigint"))


_RULE_SQL = "q as (select id rule_id, max(question) txt from qa_dataset group by id having max(question) is not null), sp as (select *, string_split(regexp_replace(txt, '则|那么|就', chr(1)), chr(1)) p from q), att as (select rule_id, case when len(p) = 2 then list_append(list_transform(list_filter(list_transform(string_split_regex(regexp_replace(trim(p[1]), '^如果|^若|^当', ''), '且|并|and|AND'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {'k': case when regexp_matches(x, '[<>=]') then 'comparison' else 'class_membership' end, 't': x}), {'k': 'conclusion', 't': trim(p[2])}) else [{'k': 'relation', 't': txt}] end a from sp), atom as (select rule_id, i - 1 pos, a[i].k kind, a[i].t txt from (select *, unnest(range(1, len(a) + 1)) i from att))"


def generated_rules(s, d):
    """(rule_id, problem) of the rules made from all questions."""
    q = table(s, d, "qa_dataset").groupBy("id").agg(F.max("question").alias("text")).select(F.col("id").alias("rule_id"), "text")
    parts = cut(so.split_rule(q))
    atoms = so.generate_rules(parts, cut(so.bind(parts, concepts(s, d))))
    return so.validate_rules(atoms, q.where("text is not null").select("rule_id"), concepts(s, d).select("name"), properties(s, d).select("name"))


_BOUND = _BASE + ", " + _RULE_SQL + ", nm as (select distinct name from con where length(name) >= 2), bd as (select rule_id, pos, min(name) as concept from atom join nm on contains(lower(atom.txt), lower(nm.name)) where kind <> 'conclusion' group by 1, 2)"
_GENERATED = _BOUND + """, b as (select distinct rule_id, case kind when 'comparison' then 'builtin' else concept end p from atom join bd using (rule_id, pos)), hd as (select distinct c.rule_id, bd.concept p from atom c join atom k on k.rule_id = c.rule_id and k.txt = c.txt and k.kind <> 'conclusion' join bd on bd.rule_id = k.rule_id and bd.pos = k.pos where c.kind = 'conclusion'),
f as (select q.rule_id, exists (select 1 from b where b.rule_id = q.rule_id) hb, exists (select 1 from hd where hd.rule_id = q.rule_id) hh, exists (select 1 from b where b.rule_id = q.rule_id and p = 'builtin') bi, exists (select 1 from b where b.rule_id = q.rule_id and p <> 'builtin') cl from q)
select rule_id, unnest(list_filter([case when not hb then 'empty_body' end, case when not hh then 'empty_head' end, case when hh and not hb then 'unbound:?x' end, case when bi then case when cl then 'builtin:?y' else 'builtin:?x,?y' end end], lambda x: x is not null)) as problem from f"""


#: Relations of the sample that undo each other.
INVERSES = [("contains", "belongsTo"), ("ownsOrder", "placesOrder"), ("noSuch", "contains")]


def rel_inverse(s, d):
    return so.inverses(relations(s, d), s.createDataFrame(INVERSES, "name string, inverse string"))


def join_patterns_known(s, d):
    """Tables read together that the properties' sources know."""
    known = table(s, d, "onto_property").where("source_ref like '%.%'").select(F.substring_index("source_ref", ".", 1).alias("table_name"))
    return querylog.joins(table(s, d, "query_log"), known)


def ops_log(s, d):
    """Operations on the tables that concepts are named after: the last word of a code name is what a query's table may be called."""
    c = concepts(s, d).select("id", F.get(F.col("aliases"), 0).alias("name"), F.regexp_extract("name_en", r"([A-Za-z]+)$", 1).alias("name_en")).where("name is not null and name_en != ''")
    return querylog.operations(table(s, d, "query_log"), c)


def domain_conflicts(s, d):
    """Relations whose domain lies under another root than the domain axiom of their name says."""
    r = relations(s, d).where("domain is not null").join(hierarchy.shared_sets(table(s, d, "taxonomy_node")).select(F.col("concept_id").alias("domain"), F.col("root_id").alias("cls")), "domain").select("relation_id", "name", "cls")
    declared = so.vote(r.select(F.col("name").alias("predicate"), "cls"), floor=0.0).select("predicate", F.col("winner").alias("cls"))
    return so.domain_conflicts(declared, r)


_CONFLICTS = _ALL + ", r as (select relation_id, rel.name, t.root cls from rel join t on t.id = rel.domain), n as (select name, cls, count(*) n from r group by 1, 2), w as (select name, arg_min(cls, (-n, cls)) w from n group by 1) select r.relation_id, r.name as predicate, w.w as declared, r.cls as actual from r join w using (name) where w.w <> r.cls"


def structure_check(s, d):
    """Messages per check of the whole ontology: references of all kinds to unknown concepts or subjects, and cycles."""
    docs = table(s, d, "documents").select("doc_id", "text")
    c = concepts(s, d)
    l = hierarchy.links(table(s, d, "taxonomy_node"))
    n = table(s, d, "taxonomy_node").select(norm_id("concept_id").alias("id"), norm_id("parent_id").alias("parent")).where("id is not null and parent is not null").distinct()
    trig = table(s, d, "onto_property").select("id", F.explode(F.regexp_extract_all("derivation_formula", F.lit(r"\((\w+)\)"), F.lit(1))).alias("ref"))
    subjects = s.createDataFrame([("管理员",), ("普通客户",), ("代理商",)], "name string")
    perm = mining.subjects(docs, s.createDataFrame([], "name string, parent string")).select("name")
    log = table(s, d, "query_log").select("log_id", F.explode(F.regexp_extract_all(F.lower("sql"), F.lit(r"(?:from|join)\s+([a-z_][a-z0-9_]*)"), F.lit(1))).alias("ref"))
    refs = {
        "property.domain": properties(s, d).select(F.col("id").alias("row"), F.col("owner").alias("ref")),
        "relation.domain": relations(s, d).select(F.col("relation_id").alias("row"), F.col("domain").alias("ref")),
        "relation.range": relations(s, d).select(F.col("relation_id").alias("row"), F.col("range").alias("ref")),
        "taxonomy.parent": n.select(F.col("id").alias("row"), F.col("parent").alias("ref")),
        "trigger.property": trig.select(F.col("id").alias("row"), "ref"),
        "permission.subject": perm.select(F.col("name").alias("row"), F.col("name").alias("ref")),
        "pattern.table": log.select(F.col("log_id").cast("string").alias("row"), "ref"),
    }
    ids = c.select("id")
    known = {"trigger.property": properties(s, d).select(F.col("name").alias("id")), "permission.subject": subjects.select(F.col("name").alias("id")), "pattern.table": c.where("source_ref like 'table:%'").select(F.substring("source_ref", 7, 1000).alias("id"))}
    return so.structure_check(refs, ids, known, l.select(F.col("id").alias("child"), "parent"))


_STRUCTURE = _P6_FOUND[: _P6_FOUND.index("select id as concept_id, 'tree'")].rstrip() + ", " + _BASE[5:].rstrip() + f""", nodes as (select distinct {_id('concept_id')} id, {_id('parent_id')} parent from taxonomy_node),
trg as (select id, unnest(regexp_extract_all(derivation_formula, '\\((\\w+)\\)', 1)) ref from onto_property), prm as (select distinct n from (select unnest(regexp_extract_all(text, '{mining.ROLES.replace("'", "''")}', 1)) n from documents) where length(n) between 2 and 10),
pat as (select log_id, unnest(regexp_extract_all(lower(sql), '(?:from|join)\\s+([a-z_][a-z0-9_]*)', 1)) ref from query_log),
c as (select 'property.domain' as "check", count(*) n from prop where owner <> '' and owner not in (select id from con where id is not null) union all select 'relation.domain', count(*) from rel where domain is not null and domain not in (select id from con where id is not null)
 union all select 'relation.range', count(*) from rel where range is not null and range not in (select id from con where id is not null) union all select 'taxonomy.parent', count(*) from nodes where id is not null and parent is not null and parent not in (select id from con where id is not null)
 union all select 'trigger.property', count(*) from (select distinct id, ref from trg) where ref not in (select name from prop where name is not null) union all select 'permission.subject', count(*) from prm where n not in ('管理员', '普通客户', '代理商')
 union all select 'pattern.table', count(*) from (select distinct log_id, ref from pat) where ref not in (select substring(source_ref, 7) from con where source_ref like 'table:%')) select * from c where n > 0 union all select 'taxonomy.cycle', count(*) from (select 1 from e where k = 1) having count(*) > 0"""


def derived_of_concepts(s, d):
    """Derived properties of each concept with their formulas."""
    p = properties(s, d).where("formula is not null and trim(formula) != '' and owner is not null")
    return p.groupBy(F.col("owner").alias("id")).agg(F.count(F.lit(1)).alias("n_derived"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "name", "formula"))), "|").alias("derived"))


def scenario_steps(s, d):
    """The seven steps over the whole ontology: what is added lies beside all rows of the tables."""
    t = {k: cut(v) for k, v in _kinds(s, d).items()}
    t["axioms"] = s.createDataFrame([], "id string, axiom_type string, subject string, object string, confidence double")
    e = Editor(s, t)
    new = [{"id": f"concept_new{i}", "name": n, "source": "text"} for i, n in enumerate(("甲", "乙", "丙"))]
    sub = [("concept_new1", "concept_new0"), ("concept_new2", "concept_new1")]
    rel = [{"id": "rel_new0", "name": "新关系", "domain": "concept_new0", "range": "concept_new2"}]
    out = scenario(e, new, sub, rel, [("concept_new2", "新关系", True), ("concept_new0", "无此关系", False)], [("concept_new0", "concept_new2"), ("concept_new2", "concept_new1")], [("concept_new2", "concept_new0", True), ("concept_new0", "concept_new2", False)], [])
    return out.select(F.col("step").cast("bigint").alias("step"), "name", "ok", "detail")


QUERIES = {
    "ddl_tables": ddl_tables,
    "ddl_columns": ddl_columns,
    "ddl_fks": ddl_fks,
    "rdb_concepts": rdb_concepts,
    "ddl_properties": ddl_properties,
    "identity_of_tables": identity_of_tables,
    "junction_relations": junction_relations,
    "log_scan": log_scan,
    "saved_ontology": saved_ontology,
    "edited_ontology": edited_ontology,
    "mermaid_classes": mermaid_classes,
    "schema_check": schema_check,
    "usable_columns": usable_columns,
    "bridge_fields": bridge_fields,
    "ddl_completion": ddl_completion,
    "taxonomy_attach": taxonomy_attach,
    "cycle_removed": cycle_removed,
    "topo_levels": topo_levels,
    "rule_bindings": rule_bindings,
    "generated_rules": generated_rules,
    "rel_inverse": rel_inverse,
    "join_patterns_known": join_patterns_known,
    "ops_log": ops_log,
    "domain_conflicts": domain_conflicts,
    "structure_check": structure_check,
    "structure_check": structure_check,
    "derived_of_concepts": derived_of_concepts,
    "scenario_steps": scenario_steps,
}
ORACLE = {
    "ddl_tables": _RDB + 'select table_name, comment, (select count(*) from cols c where c.table_name = tb.table_name) as n_columns, (select count(*) from fk where fk.table_name = tb.table_name) as n_fks from tb',
    "ddl_columns": _RDB + "select table_name, row_number() over (partition by table_name order by o, column_name) - 1 as pos, column_name, sql_type, comment, is_primary_key from cols",
    "ddl_fks": _RDB + "select table_name, fk_column, ref_table, 'id' as ref_column from fk",
    "rdb_concepts": _RDB + f"select case when l <> '' then l else table_name end as name, table_name, .9::double as confidence from (select table_name, regexp_replace(trim(comment), '信息表|表|记录', '', 'g') l from tb where not regexp_matches(lower(table_name), '{profile.SYSTEM_TABLE}')) union all select distinct ref_table, ref_table, .7 from fk where regexp_matches(lower(ref_table), '{profile.SYSTEM_TABLE}')",
    "ddl_properties": _RDB + "select table_name, column_name as name, case sql_type when 'BIGINT' then 'int' when 'DECIMAL(10,2)' then 'float' when 'DATETIME' then 'date' else 'string' end as value_type, table_name || '.' || column_name as source_ref, .9::double as confidence from cols where not is_primary_key and (table_name, column_name) not in (select (table_name, fk_column) from fk)",
    "identity_of_tables": _RDB + "select table_name, array_to_string(list_sort(list(column_name)), ' + ') as identity_spec from cols where is_primary_key group by 1",
    "junction_relations": _BASE + "select 'link_' || relation_id as name, 'of_' || domain as domain, 'of_' || range as range, 'N:M' as cardinality, .8::double as confidence from rel where cardinality = 'N:M' and domain is not null and range is not null",
    "log_scan": "select sql, frequency, count(*) as n_rows from query_log where sql is not null group by 1, 2",
    "saved_ontology": _SAVED,
    "edited_ontology": _EDITED,
    "mermaid_classes": _P6.rstrip() + " select distinct '  `' || parent || '` <|-- `' || id || '`' as line from l where parent is not null",
    "schema_check": _SCHEMA,
    "usable_columns": _USABLE_SQL,
    "bridge_fields": _BRIDGES,
    "ddl_completion": _COMPLETE,
    "cycle_removed": _CYCLE_REMOVED,
    "topo_levels": _P6.rstrip() + ", e as (select parent from l where parent is not null) select id, depth as level from t where depth > 0 or id in (select parent from e)",
    "rule_bindings": _BOUND + " select rule_id, pos, concept from bd",
    "generated_rules": _GENERATED,
    "rel_inverse": _BASE + f", y as (select * from {_values(INVERSES)} v(a, b)), p as (select a, b from y union select b, a from y), m as (select name, min(relation_id) i from rel group by 1) select relation_id, m.i as inverse_id from rel join p on p.a = rel.name join m on m.name = p.b",
    "join_patterns_known": f"{_CLEAN}, k as (select distinct lower(string_split(source_ref, '.')[1]) t from onto_property where source_ref like '%.%'), s as (select log_id, list_distinct(regexp_extract_all(q, '{_TAB}', 1)) a from l), e as (select row_number() over () r, a from s where len(a) >= 2), x as (select r, list_sort(list(k.t)) b from (select r, unnest(a) t from e) u join k using (t) group by 1 having count(*) >= 2) select array_to_string(b, '|') as tables, case when len(b) > 3 then 'cross_source' else 'join_query' end as kind, count(*) as n_queries from x group by 1, 2",
    "ops_log": _BASE + ", " + _CRUD[5:] + ", w as (select id, aliases[1] nm, lower(regexp_extract(name_en, '([A-Za-z]+)$', 1)) t from con), n as (select t, arg_min(nm, id) nm from w where nm is not null and t <> '' group by 1), o as (select case verb when 'select' then '查询' when 'insert' then '创建' when 'update' then '更新' when 'delete' then '删除' end || nm as name, nm as concept_name, sum(n_queries)::bigint n from crud join n on n.t = crud.table_name group by 1, 2) select name, concept_name, n as n_queries from o where name is not null or concept_name is not null",
    "domain_conflicts": _CONFLICTS,
    "structure_check": _STRUCTURE,
    "taxonomy_attach": _ALL + f", b as (select distinct a.name child from l join con a using (id) join con b on b.id = l.parent), h as ({_HEARST}) select child, arg_min(parent, (-confidence, parent)) as parent, max(confidence) as confidence from h where child not in (select child from b where child is not null) group by 1",
    "derived_of_concepts": _BASE + "select owner as id, count(*) as n_derived, array_to_string(list_sort(list_distinct(list(name || '=' || formula))), '|') as derived from prop where trim(formula) <> '' and owner <> '' group by 1",
    "scenario_steps": "select * from (values (1, 'add_concepts', true, '3 added'), (2, 'add_taxonomy', true, '2 added'), (3, 'add_relations', true, '1 added'), (4, 'verify_inheritance', true, '2 checked'), (5, 'multi_hop', true, '1 of 2 reachable'), (6, 'subclass_closure', true, '2 checked'), (7, 'triggers', true, '0 fired')) v(step, name, ok, detail)",
}
