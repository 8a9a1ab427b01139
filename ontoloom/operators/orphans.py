"""Problem 2: references to records that do not exist.

A Bloom filter of the parents' keys, of bounded size, proves most orphans without any join; references that the filter
lets through are verified by an exact join with the parents' first load and last life-cycle event.

Results:
* null or blank references make no row; references and keys compare lower-cased and stripped of any white space;
* copies of a row (same id) are merged before: its reference, created_at and loaded_at are those of its first load;
* a null loaded_at is never late, a null created_at gives a null period; change entries without time sort first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions import bloom
from ontoloom.functions.ids import norm_id, strip

FIELDS = {"onto_property": ("domain_concept_id",), "onto_relation": ("domain_concept_id", "range_concept_id")}
MAX_BITS = 1 << 26


def references(tables: dict[str, DataFrame], fields: dict[str, tuple[str, ...]] = FIELDS) -> DataFrame:
    """(ref_table, row_id, ref_field, key, created_at, first_load), one row per row id and field; the fields of a table are unpivoted in one scan."""
    out = None
    for name, cols in fields.items():
        first = tables[name].groupBy(F.col("id").alias("row_id")).agg(*[F.min_by(norm_id(c), F.struct(F.col("loaded_at").isNull(), "loaded_at", norm_id(c))).alias(c) for c in cols], F.min("created_at").alias("created_at"), F.min("loaded_at").alias("first_load"))
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("key")) for c in cols]))
        refs = first.select(F.lit(name).alias("ref_table"), "row_id", pairs.alias("x"), "created_at", "first_load").select("ref_table", "row_id", "x.ref_field", "x.key", "created_at", "first_load").where("key is not null")
        out = refs if out is None else out.unionByName(refs)
    return out


def parents(concepts: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, parent_load, last_op) of each concept; both sides are pre-aggregated, so no key is hot in the join."""
    known = concepts.select(norm_id("id").alias("key"), "loaded_at").where("key is not null").groupBy("key").agg(F.min("loaded_at").alias("parent_load"))
    op = F.lower(strip("op"))
    last = changes.select(norm_id("ref").alias("key"), op.alias("op"), F.lower(strip("target")).alias("target"), "changed_at", "change_id").where("target = 'concept' and op in ('create', 'delete') and key is not null").groupBy("key").agg(F.max_by("op", F.struct(F.col("changed_at"), F.col("change_id"))).alias("last_op"))
    return known.join(last, "key", "left")


def orphans(tables: dict[str, DataFrame], concepts: DataFrame, changes: DataFrame, fields: dict[str, tuple[str, ...]] = FIELDS, max_bits: int = MAX_BITS) -> DataFrame:
    """ref_table, row_id, ref_field, period, reason (missing, deleted, late) of each reference that leads nowhere."""
    refs, home = references(tables, fields), parents(concepts, changes)
    words = bloom.build(concepts.select(norm_id("id").alias("key")), "key", max_bits)
    marked = refs.withColumn("maybe", bloom.might_contain(refs, words, F.col("key")))
    # proven orphans take no part in the join
    sure = marked.where(~F.col("maybe")).withColumn("reason", F.lit("missing"))
    checked = marked.where("maybe").join(home.withColumn("known", F.lit(True)), "key", "left")
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("last_op") == "delete", "deleted").when(F.col("parent_load") > F.col("first_load"), "late")
    both = sure.select("ref_table", "row_id", "ref_field", "created_at", "reason").unionByName(checked.withColumn("reason", reason).select("ref_table", "row_id", "ref_field", "created_at", "reason"))
    return both.where("reason is not null").select("ref_table", "row_id", "ref_field", F.date_format("created_at", "yyyy-MM").alias("period"), "reason")


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, period and reason."""
    return found.groupBy("ref_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"))
