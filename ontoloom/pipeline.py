"""The seven stages from sources to a validated ontology, each a function of tables to tables, lazy up to the sinks.

    python -m ontoloom.pipeline --ddl 'ddl/*.sql' --docs docs --queries 'queries/*.jsonl' --config domain.yaml --out out
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.ids import det_id
from ontoloom.functions.text import trim
from ontoloom.operators import concepts as con
from ontoloom.operators import enrich, graph, hierarchy, mining, profile, querylog
from ontoloom.operators import schema_ops as so
from ontoloom.session import cut, get_session
from ontoloom.sources import ddl, files

Tables = dict[str, DataFrame]


def load(spark: SparkSession, ddl_path: str, docs: str, queries: str, config: str = "") -> Tables:
    """Stage 1: parsed tables, documents, query log and configuration, with quality scores of the tables."""
    t = files.config_tables(spark, files.config(config) if config else {})
    parsed = cut(ddl.scan(spark, ddl_path))
    t |= {"parsed": parsed, "columns": ddl.columns(parsed), "fks": ddl.foreign_keys(parsed)}
    t["docs"] = files.documents(spark, docs).select(F.col("path").alias("doc_id"), "text")
    log = files.query_log(spark, queries)
    t["log"] = log.withColumn("log_id", F.xxhash64("sql"))
    has = t["fks"].select("table_name").distinct().withColumn("has_fk", F.lit(True))
    tables = parsed.select("table_name", "comment").join(has, "table_name", "left").fillna(False, ["has_fk"])
    t["scores"] = profile.table_scores(t["columns"].select("table_name", "column_name", "comment", F.lit(None).cast("double").alias("null_rate")), tables)
    return t


def identity(columns: DataFrame) -> DataFrame:
    """(table_name, identity_spec): primary key columns in order of name, joined with ' + '."""
    return columns.where("is_primary_key").groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list("column_name")), " + ").alias("identity_spec"))


def column_properties(columns: DataFrame, fks: DataFrame, c: DataFrame) -> DataFrame:
    """Properties of the columns that are no keys; c: id, table_name of the concepts."""
    plain = columns.join(fks.select("table_name", F.col("fk_column").alias("column_name")), ["table_name", "column_name"], "left_anti").where("not is_primary_key")
    return plain.join(c, "table_name").select(det_id("prop", F.col("table_name"), F.col("column_name")).alias("id"), F.col("column_name").alias("name"), F.col("id").alias("domain_concept_id"), F.col("comment").alias("name_cn"), so.value_type(F.col("sql_type")).alias("value_type"), "sql_type", F.concat_ws(".", "table_name", "column_name").alias("source_ref"), F.lit(0.9).alias("confidence"))


def junction_relations(columns: DataFrame, fks: DataFrame, c: DataFrame) -> DataFrame:
    """An N:M relation between the ends of each junction table; c: id, table_name of the concepts."""
    j = so.junctions(columns, fks).join(c.select(F.col("id").alias("domain"), F.col("table_name").alias("a")), "a").join(c.select(F.col("id").alias("range"), F.col("table_name").alias("b")), "b")
    return j.select(det_id("rel", F.col("table_name")).alias("relation_id"), F.col("table_name").alias("name"), "domain", "range", F.lit("N:M").alias("cardinality"), F.lit(0.8).alias("confidence"), F.array().cast("array<string>").alias("aliases"))


def table_concepts(parsed: DataFrame) -> DataFrame:
    """Concepts of tables that are no system tables, named by their comments; foreign keys' targets without a table of their own too."""
    label = F.regexp_replace(trim("comment"), "信息表|表|记录", "")
    base = parsed.where(~profile.is_system(F.col("table_name"))).select("table_name", F.when(label != "", label).otherwise(F.col("table_name")).alias("name"), F.lit(0.9).alias("confidence"))
    refs = parsed.select(F.explode("foreign_keys.ref_table").alias("table_name")).distinct().join(base.select("table_name"), "table_name", "left_anti").select("table_name", F.col("table_name").alias("name"), F.lit(0.7).alias("confidence"))
    return base.unionByName(refs).select(det_id("concept", F.col("name")).alias("id"), "name", F.col("table_name").alias("name_en"), F.lit("rdb").alias("source"), F.concat(F.lit("table:"), "table_name").alias("source_ref"), "confidence", F.lit(None).cast("bigint").alias("instance_count"))


def extract_concepts(t: Tables) -> Tables:
    """Stage 2: concepts of tables and texts, merged by name, with layer."""
    text = mining.concepts(mining.phrases(t["docs"])).select(det_id("concept", F.col("name")).alias("id"), "name", F.lit(None).cast("string").alias("name_en"), F.lit("text").alias("source"), F.lit("docs").alias("source_ref"), "confidence", F.col("instance_count").cast("bigint").alias("instance_count"))
    rdb = profile.keep_by_quality(table_concepts(t["parsed"]), t["scores"])
    every = rdb.unionByName(text)
    one = every.groupBy(F.lower(trim("name")).alias("k")).agg(F.max_by(F.struct(*every.columns), F.struct("confidence", "id")).alias("v")).select("v.*")
    one = one.withColumn("layer", con.layer(F.col("name"), F.col("name_en"), F.col("source"), F.col("source_ref").startswith("table:")))
    key = identity(t["columns"])
    return t | {"concepts": cut(one.join(key, one.name_en == key.table_name, "left").drop("table_name"))}


def by_name(links: DataFrame, t: Tables) -> DataFrame:
    """links (child, parent, confidence) with aliases replaced by the names of their concepts, links of a concept to itself left out."""
    a = t["concept_synonyms"].groupBy("alias").agg(F.min("standard").alias("standard"))
    for c in ("child", "parent"):
        links = links.join(a.select(F.col("alias").alias(c), F.col("standard").alias("std")), c, "left").withColumn(c, F.coalesce("std", c)).drop("std")
    return links.where("child != parent").groupBy("child", "parent").agg(F.max("confidence").alias("confidence"))


def build_taxonomy(t: Tables) -> Tables:
    """Stage 3: is-a links of texts and of names, without cycles."""
    names = t["concepts"].select("id", "name")
    held = con.substring_hierarchy(t["concepts"].select("name", "instance_count"))
    links = held.unionByName(graph.attach(held, by_name(mining.hearst(t["docs"]).select("child", "parent", "confidence"), t)))
    e = links.groupBy("child", "parent").agg(F.max("confidence").alias("confidence"))
    known = e.join(names.select(F.col("name").alias("child")), "child", "left_semi").join(names.select(F.col("name").alias("parent")), "parent", "left_semi")
    kept, removed = graph.remove_cycles(known)
    names_ = kept.select(F.col("child").alias("id")).unionByName(kept.select(F.col("parent").alias("id"))).distinct()
    tops = names_.join(kept.select(F.col("child").alias("id")), "id", "left_anti").withColumn("parent", F.lit(None).cast("string"))
    one = kept.groupBy(F.col("child").alias("id")).agg(F.max_by("parent", F.struct("confidence", "parent")).alias("parent")).unionByName(tops)
    depths = hierarchy.climb(one)[0].select(F.col("id").alias("name"), F.col("root").alias("root"), "depth")
    return t | {"taxonomy": kept, "removed_links": removed, "taxonomy_depths": depths}


def build_relations(t: Tables) -> Tables:
    """Stage 4: properties of columns, relations of foreign keys and junction tables, N:M ones reified, names normalised, limits of types."""
    c = t["concepts"].where("name_en is not null").select("id", F.col("name_en").alias("table_name"))
    props = column_properties(t["columns"], t["fks"], c).select("id", "name", "domain_concept_id", "name_cn", "value_type", "source_ref", *so.type_limits(F.col("sql_type")))
    used = t["log"].select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit("([a-z_]+)"), F.lit(1)))).alias("column_name")).distinct()
    fk = t["fks"].select(F.concat_ws(".", "table_name", "fk_column").alias("fk_id"), "table_name", F.col("fk_column").alias("column_name"), F.col("ref_table").alias("term"), "ref_table")
    judged = so.fk_filter(fk, used, t["terms"], profile.is_system_fk(F.col("table_name"))).where("status != 'rejected'")
    ends = fk.join(judged, "fk_id").join(c.select(F.col("id").alias("domain"), "table_name"), "table_name").join(c.select(F.col("id").alias("range"), F.col("table_name").alias("ref_table")), "ref_table")
    rels = ends.select(det_id("rel", F.col("fk_id")).alias("relation_id"), so.relation_name(F.col("ref_table")).alias("name"), "domain", "range", F.lit("1:N").alias("cardinality"), "confidence", F.array().cast("array<string>").alias("aliases"))
    nm = junction_relations(t["columns"], t["fks"], c)
    every = rels.unionByName(nm)
    return t | {"properties": props, "relations": every, "reified": so.reify(every, t["concepts"].select("id", "name")), "reified_concepts": so.reified_concepts(every, t["concepts"].select("id", "name")), "normalised": so.normalise(every, t["relation_synonyms"])}


def check_consistency(t: Tables) -> Tables:
    """After stage 5: (check, n) of what is broken: references to unknown concepts, cycles, domains other than the axioms say; warnings only."""
    ids = t["concepts"].select("id")
    refs = {"property.domain": t["properties"].select(F.col("id").alias("row"), F.col("domain_concept_id").alias("ref")), "relation.domain": t["relations"].select(F.col("relation_id").alias("row"), F.col("domain").alias("ref")), "relation.range": t["relations"].select(F.col("relation_id").alias("row"), F.col("range").alias("ref"))}
    one = t["taxonomy"].groupBy("child").agg(F.max_by("parent", F.struct("confidence", "parent")).alias("parent"))
    broken = so.structure_check(refs, ids, {}, one)
    declared = t["axioms"].where("axiom_type = 'domain'").select(F.col("subject").alias("predicate"), F.col("object").alias("cls"))
    conflicts = so.domain_conflicts(declared, t["relations"].select("relation_id", "name", F.col("domain").alias("cls")))
    return t | {"consistency": broken.unionByName(conflicts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("domain.axiom").alias("check"), "n").where("n > 0"))}


def stage_report(t: Tables) -> DataFrame:
    """(output, n_rows, columns) of each output table."""
    out = None
    for k, df in t.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("output"), "n_rows", F.lit(", ".join(df.columns)).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


def build_axioms(t: Tables) -> Tables:
    """Stage 5: subClassOf, domain and range axioms with risk and status, rejected ones left out."""
    sub = t["taxonomy"].select(F.lit("subClassOf").alias("axiom_type"), F.col("child").alias("subject"), F.col("parent").alias("object"), "confidence")
    voted = lambda side: so.vote(t["relations"].select(F.col("name").alias("predicate"), F.col(side).alias("cls"))).where("winner is not null").select(F.lit(side).alias("axiom_type"), F.col("predicate").alias("subject"), F.col("winner").alias("object"), F.col("share").alias("confidence"))
    a = sub.unionByName(voted("domain")).unionByName(voted("range"))
    a = a.select(det_id("axiom", F.col("axiom_type"), F.col("subject"), F.col("object")).alias("id"), "*", so.risk(F.col("axiom_type")).alias("risk"), so.risk_status(F.col("axiom_type"), F.col("confidence")).alias("status"))
    return t | {"axioms": a.where("status != 'rejected'")}


def enrich_all(t: Tables) -> Tables:
    """Stage 6: glossary, mappings, annotations, triggers, derivations and limits."""
    g = enrich.glossary(t["concept_synonyms"], t["concepts"])
    terms = g.select("term", det_id("term", F.col("term")).alias("id"))
    return t | {"glossary_terms": g, "external_mappings": enrich.external_mapping(t["mappings"], terms), "semantic_annotations": enrich.annotations(t["properties"]), "trigger_rules": mining.triggers(t["docs"]), "derivations": mining.derivations(t["docs"]).unionByName(querylog.derivations(t["log"], t["properties"]).select(F.col("property_name").alias("target"), "formula", F.lit(0).cast("bigint").alias("n_docs"))), "limits": mining.limits(t["docs"])}


def process_all(t: Tables) -> Tables:
    """Stage 7: operations, flows, permissions and query patterns."""
    return t | {"atomic_operations": mining.operations(t["docs"]), "query_operations": querylog.operations(t["log"], t["concepts"]), "service_compositions": mining.flows(t["docs"]), "permission_rules": mining.permissions(t["docs"], t["subjects"]), "query_patterns": querylog.crud(t["log"])}


OUTPUTS = "concepts taxonomy taxonomy_depths properties relations reified reified_concepts normalised axioms consistency glossary_terms external_mappings semantic_annotations trigger_rules derivations limits atomic_operations query_operations service_compositions permission_rules query_patterns scores".split()
#: Stages by number; consistency is checked with the axioms.
STAGES = {2: extract_concepts, 3: build_taxonomy, 4: build_relations, 5: lambda t: check_consistency(build_axioms(t)), 6: enrich_all, 7: process_all}


def run(spark: SparkSession, ddl_path: str, docs: str, queries: str, config: str = "", last: int = 7) -> Tables:
    """Outputs of the stages up to `last`."""
    t = load(spark, ddl_path, docs, queries, config)
    for n, stage in STAGES.items():
        if n <= last:
            t = stage(t)
    return {k: t[k] for k in OUTPUTS if k in t}


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for a in ("ddl", "docs", "queries", "out"):
        p.add_argument(f"--{a}", required=True)
    p.add_argument("--config", default="")
    p.add_argument("--stage", type=int, default=7, choices=range(1, 8), help="last stage to run")
    a = p.parse_args()
    tables = run(get_session(), a.ddl, a.docs, a.queries, a.config, a.stage)
    files.save_ontology(tables, a.out)
    files.save_report(stage_report(tables), f"{a.out}/stage_report")
    if "consistency" in tables:
        files.save_report(tables["consistency"], f"{a.out}/consistency_report")


if __name__ == "__main__":
    main()
