"""Glossary, mappings, annotations, governance, and edits of an ontology as table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.ids import norm_id, strip
from ontoloom.functions.text import trim


def glossary(synonyms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(term, origin, synonyms): configured terms (standard, alias), and concept names that aren't one."""
    s = synonyms.groupBy(F.col("standard").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("synonyms")).withColumn("origin", F.lit("config"))
    c = concepts.select(trim("name").alias("term")).where("term is not null and term != ''").distinct().join(s.select("term"), "term", "left_anti")
    return s.select("term", "origin", "synonyms").unionByName(c.select("term", F.lit("concept").alias("origin"), F.lit("").alias("synonyms")))


def external_mapping(mappings: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, uri, target): the glossary id of each mapped term, the raw term where there is none.  terms: term, id."""
    return mappings.join(terms, "term", "left").select("term", "uri", F.coalesce("id", "term").alias("target"))


def annotations(properties: DataFrame) -> DataFrame:
    """(table_name, column_name, annotation): comment of each column of the relational source, the least where rows differ.  source_ref is table.column."""
    p = properties.where("source_ref like '%.%' and name_cn is not null and trim(name_cn) != ''")
    return p.groupBy(F.substring_index("source_ref", ".", 1).alias("table_name"), F.substring_index("source_ref", ".", -1).alias("column_name")).agg(F.min("name_cn").alias("annotation"))


def governance(concepts: DataFrame, properties: DataFrame, relations: DataFrame) -> DataFrame:
    """(rule, n_checked, n_broken): concepts need a description, a property and some relation; relations need a name in words.  concepts: id, description."""
    has = lambda df, c: df.select(norm_id(c).alias("id")).where("id is not null").distinct()
    ids = concepts.select(norm_id("id").alias("id"), "description").where("id is not null")
    ends = has(relations, "domain_concept_id").unionByName(has(relations, "range_concept_id")).distinct()
    one = ids.groupBy("id").agg(F.max(F.when(trim(F.coalesce("description", F.lit(""))) != "", 1).otherwise(0)).alias("d"))
    j = one.join(has(properties, "domain_concept_id").withColumn("p", F.lit(1)), "id", "left").join(ends.withColumn("r", F.lit(1)), "id", "left")
    n = j.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("d")).alias("description"), F.count_if(F.col("p").isNull()).alias("property"), F.count_if(F.col("r").isNull()).alias("orphan"))
    rows = n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col("n").alias("n_checked"), F.col(k).alias("n_broken")) for k in ("description", "property", "orphan")])).alias("x")).select("x.*")
    rel = relations.groupBy("id").agg(F.max("name_cn").alias("w")).agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(F.coalesce(trim("w"), F.lit("")) == "").alias("n_broken")).select(F.lit("relation_description").alias("rule"), "n_checked", "n_broken")
    return rows.unionByName(rel)


def change_summary(log: DataFrame) -> DataFrame:
    """(op, target, n) of a change log whose labels vary in spelling; entries written twice count once."""
    e = log.select(F.lower(strip("op")).alias("op"), F.lower(strip("target")).alias("target"), norm_id("ref").alias("ref"), "changed_at").distinct()
    return e.groupBy("op", "target").agg(F.count(F.lit(1)).alias("n"))


def current_ids(log: DataFrame, target: str) -> DataFrame:
    """(ref, alive): whether the last create or delete of each element was a create."""
    e = log.select(F.lower(strip("op")).alias("op"), F.lower(strip("target")).alias("target"), norm_id("ref").alias("ref"), "changed_at", "change_id").where(F.col("target") == target).where("op in ('create', 'delete') and ref is not null")
    return e.groupBy("ref").agg((F.max_by("op", F.struct("changed_at", "change_id")) == "create").alias("alive"))


def apply_changes(df: DataFrame, key: str, log: DataFrame, target: str) -> DataFrame:
    """Rows of df whose element wasn't deleted last, with its key normalised; elements without a log entry stay."""
    gone = current_ids(log, target).where("not alive").select(F.col("ref").alias("__ref"))
    return df.withColumn("__ref", norm_id(key)).join(gone, "__ref", "left_anti").drop("__ref")


def cascade(tables: dict[str, DataFrame], deleted: DataFrame, references: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Tables without the deleted ids (column id) and without rows that refer to one."""
    out = {}
    for name, df in tables.items():
        for c in ["id", *references.get(name, [])]:
            df = df.join(deleted.select(F.col("id").alias("__gone")), norm_id(c) == F.col("__gone"), "left_anti")
        out[name] = df
    return out


def upsert(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """df with the rows of changes put in or, where the key exists, over it; a null in a change leaves the old value."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"__new_{c}") for c in df.columns if c != key and c in changes.columns])
    j = df.withColumn("__old", F.lit(True)).join(new, key, "full")
    return j.select(*[F.col(key) if c == key else (F.coalesce(f"__new_{c}", c) if c in changes.columns else F.col(c)).alias(c) for c in df.columns])


def inbox(messages: DataFrame, agent: str) -> DataFrame:
    """Messages (pos, sender, recipient, text) to the agent or to all, in order; own broadcasts are left out."""
    return messages.where((F.col("recipient") == agent) | ((F.col("recipient") == "broadcast") & (F.col("sender") != agent))).orderBy("pos")
