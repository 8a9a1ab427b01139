"""Relations, properties, axioms, rules and consistency as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.ids import det_id
from ontoloom.functions.text import substrings, trim
from ontoloom.session import cut

#: Types of literals, risk of axioms, words of part-of relations.
LITERALS = "int integer bigint smallint float double decimal string varchar text date datetime bool boolean".split()
RISK = {"domain": "low", "range": "low", "subClassOf": "medium", "inverseOf": "medium", "disjointWith": "high", "equivalentClass": "high", "transitiveProperty": "high"}
PART_OF = "部分|组成|包含|属于|构成|part|component"


def value_type(sql_type: Column) -> Column:
    """Ontology type of an SQL type, in order int, float, date, enum, bool, string."""
    t = F.lower(sql_type)
    return F.when(t.contains("int"), "int").when(t.rlike("decimal|float|double"), "float").when(t.rlike("date|time"), "date").when(t.contains("enum"), "enum").when(t.contains("bool"), "bool").otherwise("string")


def infer_type(value: Column) -> Column:
    """Type of a value by its text."""
    return F.when(value.isNull(), "unknown").when(F.lower(value).isin("true", "false"), "bool").when(value.rlike(r"^[+-]?\d+$"), "int").when(value.rlike(r"^[+-]?\d*\.\d+$"), "float").when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), "date").otherwise("string")


def property_or_relation(range_type: Column, has_attributes: Column, reasoning: Column, dialect: Column, is_reference: Column) -> Column:
    literal = F.lower(range_type).isin(LITERALS)
    return F.when(literal & reasoning & (dialect == "owl"), "relation").when(literal, "property").when(has_attributes, "relation").when(reasoning, F.when(dialect == "owl", "relation").otherwise("property")).when(is_reference, "relation").otherwise("property")


def type_limits(sql_type: Column) -> list[Column]:
    """max_length, max_value, min_value, format of an SQL type."""
    t = F.upper(sql_type)
    length = F.nullif(F.regexp_extract(t, r"^(?:VAR)?CHAR\((\d+)\)", 1), F.lit("")).cast("bigint")
    m, n = (F.nullif(F.regexp_extract(t, r"^DECIMAL\((\d+),\s*(\d+)\)", g), F.lit("")).cast("int") for g in (1, 2))
    dec = F.pow(F.lit(10.0), m - n) - F.pow(F.lit(10.0), -n)
    tiny, unsigned = t.contains("TINYINT"), t.contains("UNSIGNED")
    fmt = F.when(t.contains("DATE") & ~t.contains("TIME"), "yyyy-MM-dd").when(t.rlike("DATETIME|TIMESTAMP"), "yyyy-MM-dd HH:mm:ss")
    return [length.alias("max_length"), F.when(tiny & unsigned, 255.0).when(tiny, 127.0).otherwise(F.round(dec, 6)).alias("max_value"), F.when(tiny & unsigned, 0.0).when(tiny, -128.0).alias("min_value"), fmt.alias("format")]


def fk_filter(fks: DataFrame, used_columns: DataFrame, terms: DataFrame, system: Column) -> DataFrame:
    """(fk_id, status, confidence): keys of system tables and keys that no query and no business term knows are rejected, those with a term accepted, the rest need review.  fks: fk_id, table_name, column_name, term."""
    used = used_columns.select("column_name").distinct().withColumn("used", F.lit(True))
    known = terms.select("term").distinct().withColumn("known", F.lit(True))
    j = fks.withColumn("system", system).join(used, "column_name", "left").join(known, "term", "left")
    s = F.when(F.col("system"), "rejected").when(F.col("known"), "accepted").when(F.col("used"), "needs_review").otherwise("rejected")
    return j.select("fk_id", s.alias("status"), F.when(s == "accepted", 0.9).when(s == "needs_review", 0.6).otherwise(0.0).alias("confidence"))


def relation_name(ref_table: Column) -> Column:
    return F.concat(F.lit("has"), F.upper(F.substring(ref_table, 1, 1)), F.lower(F.substring(ref_table, 2, 1_000_000)))


def junctions(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """(table_name, a, b): tables of exactly two foreign keys that lie in the primary key, or of at most three columns.  columns: table_name, column_name, is_primary_key; fks: table_name, fk_column, ref_table."""
    c = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("is_primary_key"), F.col("column_name"))).alias("pk"))
    f = fks.groupBy("table_name").agg(F.count(F.lit(1)).alias("k"), F.collect_set("fk_column").alias("fk"), F.sort_array(F.collect_list(F.struct("fk_column", "ref_table"))).alias("r")).where("k = 2")
    j = c.join(f, "table_name").where((F.size(F.array_except("fk", "pk")) == 0) | (F.col("n") <= 3))
    return j.select("table_name", F.get("r", F.lit(0)).ref_table.alias("a"), F.get("r", F.lit(1)).ref_table.alias("b"))


def _split(relations: DataFrame, names: DataFrame) -> DataFrame:
    a, b = names.select(F.col("id").alias("domain"), F.col("name").alias("an")), names.select(F.col("id").alias("range"), F.col("name").alias("bn"))
    j = relations.join(a, "domain", "left").join(b, "range", "left")
    mid = F.concat_ws("_", "an", "bn", F.lit("Relation"))
    return j.withColumn("split", (F.col("cardinality") == "N:M") & F.col("an").isNotNull() & F.col("bn").isNotNull()).withColumn("mid", mid).withColumn("mid_id", det_id("concept", F.col("mid")))


def reify(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(relation_id, name, domain, range, cardinality): an N:M relation becomes two 1:N relations by way of a new concept `A_B_Relation` (reified_concepts); others and those without both ends stay.  names: id, name."""
    one = F.struct(F.concat("relation_id", F.lit("/1")).alias("relation_id"), F.concat(F.lit("has"), "mid").alias("name"), F.col("domain"), F.col("mid_id").alias("range"), F.lit("1:N").alias("cardinality"))
    two = F.struct(F.concat("relation_id", F.lit("/2")).alias("relation_id"), F.concat(F.lit("refersTo"), F.col("bn")).alias("name"), F.col("mid_id").alias("domain"), F.col("range"), F.lit("1:N").alias("cardinality"))
    same = F.struct("relation_id", "name", "domain", "range", "cardinality")
    return _split(relations, names).select(F.explode(F.when(F.col("split"), F.array(one, two)).otherwise(F.array(same))).alias("x")).select("x.*")


def reified_concepts(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, confidence, n_relations): the concepts that reify() puts between the ends of N:M relations."""
    g = _split(relations, names).where("split").groupBy(F.col("mid_id").alias("id")).agg(F.min("mid").alias("name"), F.count(F.lit(1)).alias("n_relations"))
    return g.select("id", "name", F.lit(0.8).alias("confidence"), "n_relations")


def normalise(relations: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(name, domain, range, confidence, aliases, n): relations under their standard names, equal ones merged.  synonyms: alias, standard."""
    s = synonyms.select(F.lower("alias").alias("k"), "standard")
    j = relations.withColumn("k", F.lower("name")).join(s, "k", "left").withColumn("std", F.coalesce("standard", "name"))
    al = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("std") != F.col("name"), F.array("name")).otherwise(F.array().cast("array<string>")))
    g = j.select(F.col("std").alias("name"), "domain", "range", "confidence", al.alias("al")).groupBy("name", "domain", "range")
    return g.agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("al")))), "|").alias("aliases"), F.count(F.lit(1)).alias("n"))


def inverses(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(relation_id, inverse_id): of the relations whose standard name has an inverse (pairs: name, inverse), the least relation of that name; pairs hold both ways.  relations: relation_id, name."""
    both = pairs.select("name", "inverse").unionByName(pairs.select(F.col("inverse").alias("name"), F.col("name").alias("inverse"))).distinct()
    least = relations.groupBy(F.col("name").alias("inverse")).agg(F.min("relation_id").alias("inverse_id"))
    return relations.select("relation_id", "name").join(both, "name").join(least, "inverse").select("relation_id", "inverse_id")


def vote(triples: DataFrame, floor: float = 0.8) -> DataFrame:
    """(predicate, winner, share, status, n): majority class of each predicate; 0.95 auto, 0.80 review, else skip, and no winner below floor; ties to the least class.  triples: predicate, cls; a null class votes unknown."""
    n = triples.groupBy("predicate", F.coalesce("cls", F.lit("unknown")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("predicate").agg(F.min_by("cls", F.struct(-F.col("n"), F.col("cls"))).alias("winner"), (F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n"))
    status = F.when(F.col("share") >= 0.95, "auto").when(F.col("share") >= 0.8, "review").otherwise("skip")
    return g.select("predicate", F.when(F.col("share") >= floor, F.col("winner")).alias("winner"), F.round("share", 6).alias("share"), status.alias("status"), "n")


def risk(kind: Column) -> Column:
    return F.create_map(*[x for k, v in RISK.items() for x in (F.lit(k), F.lit(v))])[kind]


def risk_status(kind: Column, confidence: Column) -> Column:
    """rejected under 0.7; auto for low risk from 0.8 and medium risk from 0.9; else review."""
    r = risk(kind)
    return F.when(confidence < 0.7, "rejected").when((r == "low") & (confidence >= 0.8), "auto").when((r == "medium") & (confidence >= 0.9), "auto").otherwise("review")


def split_rule(rules: DataFrame) -> DataFrame:
    """(rule_id, pos, kind, text): conditions and conclusion of a rule in words; one without a conclusion is one relation.  rules: rule_id, text."""
    parts = F.split("text", "则|那么|就", 2)
    has = F.size(parts) == 2
    conds = F.filter(F.transform(F.split(F.regexp_replace(trim(F.get(parts, F.lit(0))), "^如果|^若|^当", ""), "且|并|and|AND"), trim), lambda x: x != "")
    kind = lambda x: F.when(x.rlike("[<>=]"), "comparison").otherwise("class_membership")
    atoms = F.when(has, F.concat(F.transform(conds, lambda x: F.struct(kind(x).alias("kind"), x.alias("text"))), F.array(F.struct(F.lit("conclusion").alias("kind"), trim(F.get(parts, F.lit(1))).alias("text"))))).otherwise(F.array(F.struct(F.lit("relation").alias("kind"), F.col("text").alias("text"))))
    return rules.where("text is not null").select("rule_id", F.posexplode(atoms).alias("pos", "a")).select("rule_id", "pos", "a.kind", "a.text")


def bind(atoms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(rule_id, pos, concept): of the concepts whose name a condition contains, the first by name.  The join is on the text's substrings that may be names (text.substrings)."""
    names = cut(concepts.select("name").where("length(name) >= 2").distinct().withColumn("k", F.lower("name")))
    hits = substrings(atoms.where("kind != 'conclusion'").select("rule_id", "pos", "text"), "text", names).select("rule_id", "pos", "k")
    return hits.join(names, "k").groupBy("rule_id", "pos").agg(F.min("name").alias("concept"))


def generate_rules(parts: DataFrame, bound: DataFrame) -> DataFrame:
    """(rule_id, part, atom_type, predicate, variables): atoms of rules in words (split_rule) with their bindings (bind): a bound comparison compares ?x and ?y, another bound condition is a class of ?x, and so is a conclusion that is worded as a bound condition is."""
    c = parts.where("kind != 'conclusion'").join(bound, ["rule_id", "pos"])
    x, xy = F.array(F.lit("?x")), F.array(F.lit("?x"), F.lit("?y"))
    compares = F.col("kind") == "comparison"
    body = c.select("rule_id", F.lit("body").alias("part"), F.when(compares, "builtin_atom").otherwise("class_atom").alias("atom_type"), F.when(compares, "greaterThan").otherwise(F.col("concept")).alias("predicate"), F.when(compares, xy).otherwise(x).alias("variables"))
    ends = parts.where("kind = 'conclusion'").select("rule_id", "text").join(c.select("rule_id", "text", "concept"), ["rule_id", "text"])
    head = ends.select("rule_id", F.lit("head").alias("part"), F.lit("class_atom").alias("atom_type"), F.col("concept").alias("predicate"), x.alias("variables"))
    return body.unionByName(head).distinct()


def validate_rules(atoms: DataFrame, rules: DataFrame, concepts: DataFrame, properties: DataFrame) -> DataFrame:
    """(rule_id, problem): empty_body, empty_head, unbound: head variables that the body lacks, builtin: variables of comparisons that no class or property binds, unknown: predicates that are no concept or property.  atoms: rule_id, part, atom_type, predicate, variables; rules: rule_id; concepts and properties: name."""
    pick = lambda cond: F.array_distinct(F.flatten(F.collect_list(F.when(cond, F.filter("variables", lambda v: v.startswith("?"))))))
    in_body, builtin = F.col("part") == "body", F.col("atom_type") == "builtin_atom"
    g = atoms.groupBy("rule_id").agg(pick(~in_body).alias("h"), pick(in_body).alias("b"), pick(in_body & builtin).alias("bi"), pick(in_body & ~builtin).alias("cl"), F.count_if(in_body).alias("nb"), F.count_if(~in_body).alias("nh"))
    known = concepts.select(F.lit("class_atom").alias("atom_type"), F.col("name").alias("predicate")).unionByName(properties.select(F.lit("property_atom").alias("atom_type"), F.col("name").alias("predicate"))).distinct()
    strange = atoms.where("atom_type != 'builtin_atom' and predicate not in ('Thing', 'Nothing')").join(known, ["atom_type", "predicate"], "left_anti").select("rule_id", F.concat(F.lit("unknown:"), "predicate").alias("problem")).distinct()
    names = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.array_sort(c), ",")))
    n = lambda c: F.coalesce(c, F.lit(0))
    problems = F.array_compact(F.array(F.when(n("nb") == 0, F.lit("empty_body")), F.when(n("nh") == 0, F.lit("empty_head")), names("unbound:", F.array_except("h", "b")), names("builtin:", F.array_except("bi", "cl"))))
    return rules.select("rule_id").distinct().join(g, "rule_id", "left").select("rule_id", F.explode(problems).alias("problem")).unionByName(strange)


def domain_conflicts(declared: DataFrame, relations: DataFrame) -> DataFrame:
    """(relation_id, predicate, declared, actual): relations whose domain isn't that of their name's domain axiom; warnings only.  declared: predicate, cls; relations: relation_id, name, cls."""
    d = declared.select("predicate", F.col("cls").alias("declared")).where("declared is not null")
    return relations.select("relation_id", F.col("name").alias("predicate"), F.col("cls").alias("actual")).join(d, "predicate").where("declared != actual").select("relation_id", "predicate", "declared", "actual")


def structure_check(refs: dict[str, DataFrame], ids: DataFrame, known: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """(check, n) of the checks that fail: references (row, ref) to ids that aren't there, by kind of reference (known gives other ids than the concepts'), and nodes on cycles of edges (child, parent; one parent each)."""
    from ontoloom.operators import hierarchy

    out = None
    for name, df in refs.items():
        lost = df.where("ref is not null and ref != ''").select("row", "ref").distinct().join(known.get(name, ids).select(F.col("id").alias("ref")).where("ref is not null").distinct(), "ref", "left_anti")
        part = lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = part if out is None else out.unionByName(part)
    there = edges.select(F.col("child").alias("parent")).distinct().withColumn("there", F.lit(True))
    l = edges.join(there, "parent", "left").select(F.col("child").alias("id"), F.when(F.col("there"), F.col("parent")).alias("parent"))
    rings = hierarchy.cycles(hierarchy.climb(l)[1])[0].agg(F.count(F.lit(1)).alias("n")).select(F.lit("taxonomy.cycle").alias("check"), "n")
    return (rings if out is None else out.unionByName(rings)).where("n > 0")


def check_rules(atoms: DataFrame) -> DataFrame:
    """(rule_id, problem): empty_head, empty_body and unbound variables of heads.  atoms: rule_id, part (head or body), predicate, variables."""
    g = atoms.groupBy("rule_id").agg(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("part") == "head", F.col("variables"))))).alias("h"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("part") == "body", F.col("variables"))))).alias("b"), F.count_if(F.col("part") == "head").alias("nh"), F.count_if(F.col("part") == "body").alias("nb"))
    loose = F.array_sort(F.array_except("h", "b"))
    problems = F.array_compact(F.array(F.when(F.col("nh") == 0, "empty_head"), F.when(F.col("nb") == 0, "empty_body"), F.when((F.col("nb") > 0) & (F.size(loose) > 0), F.concat(F.lit("unbound:"), F.array_join(loose, ",")))))
    return g.select("rule_id", F.explode(problems).alias("problem"))


def rule_cycles(atoms: DataFrame) -> DataFrame:
    """(a, b): pairs of rules each of whose heads feeds the other's body."""
    h = atoms.where("part = 'head'").select(F.col("rule_id").alias("a"), "predicate").distinct()
    b = atoms.where("part = 'body'").select(F.col("rule_id").alias("b"), "predicate").distinct()
    f = h.join(b, "predicate").where("a != b").select("a", "b").distinct()
    return f.join(f.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])


def disjoint_violations(edges: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(a, b, child): common direct children of classes said to be disjoint.  edges: child, parent; disjoint: a, b."""
    e = edges.select("child", "parent").distinct()
    return disjoint.join(e.withColumnRenamed("parent", "a"), "a").join(e.withColumnRenamed("parent", "b"), ["b", "child"]).select("a", "b", "child")


def dangling(tables: dict[str, tuple[DataFrame, list[str]]], ids: DataFrame) -> DataFrame:
    """(entity, field, n): references to unknown ids per table and field; blank ones aren't references."""
    out = None
    for name, (df, fields) in tables.items():
        long = df.select(*[F.lower(trim(c)).alias(c) for c in fields]).unpivot([], fields, "field", "id").where("id is not null and id != ''")
        part = long.join(ids, "id", "left_anti").groupBy(F.lit(name).alias("entity"), "field").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def stats(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(entity, dimension, value, n): distribution of one column of each table."""
    out = None
    for name, (df, c) in parts.items():
        p = df.groupBy(F.lower(trim(F.col(c).cast("string"))).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), F.lit(c).alias("dimension"), "value", "n")
        out = p if out is None else out.unionByName(p)
    return out


def cardinality(pairs: DataFrame) -> DataFrame:
    """(max_b_per_a, max_a_per_b, cardinality) of a relation given by its pairs (a, b)."""
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("k")), F.struct(F.lit("b").alias("side"), F.col("b").alias("k"))))
    n = pairs.select("a", "b").distinct().select(sides.alias("x")).groupBy("x.side", "x.k").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max(F.when(F.col("side") == "a", F.col("n"))).alias("max_b_per_a"), F.max(F.when(F.col("side") == "b", F.col("n"))).alias("max_a_per_b"))
    c = F.concat(F.when(F.col("max_a_per_b") > 1, "N").otherwise("1"), F.lit(":"), F.when(F.col("max_b_per_a") > 1, F.when(F.col("max_a_per_b") > 1, "M").otherwise("N")).otherwise("1"))
    return most.withColumn("cardinality", c)


def relation_kind(a: Column, b: Column, reason: Column) -> Column:
    """is-a if one name holds the other, part-of by keyword, else related-to."""
    return F.when(a.contains(b) | b.contains(a), "is-a").when(F.coalesce(reason, F.lit("")).rlike(PART_OF), "part-of").otherwise("related-to")


def latest_rows(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
