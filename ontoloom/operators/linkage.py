"""Linking the records of several systems by shared bridge values.

entities: system, id, bridge_type, value.  Null and blank values bridge nothing; a value counts as a bridge if at least
two systems hold it; of several entities of one system the greatest id stands for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence by kind of bridge.
CONFIDENCE = {"phone": 0.98, "email": 0.97, "credit_code": 0.99, "id_card": 0.99, "external_id": 0.85}


def bridge_fields(columns: DataFrame, known: DataFrame) -> DataFrame:
    """(bridge_type, n_systems, fields): columns (system, column_name) that the dictionary (bridge_type, column_name) knows, in two systems or more."""
    hit = columns.join(known, F.lower(columns.column_name) == known.column_name).select("bridge_type", "system", columns.column_name)
    return hit.groupBy("bridge_type").agg(F.count_distinct("system").alias("n_systems"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "system", "column_name"))), "|").alias("fields")).where("n_systems >= 2")


def _confidence(kind, n):
    base = F.coalesce(F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])[kind], F.lit(0.8))
    return F.round(F.least(F.lit(1.0), base + 0.01 * (n - 2)), 6)


def mapping(entities: DataFrame) -> DataFrame:
    """(bridge_type, value, n_systems, members, confidence); per value only one member a system is kept, so a value that a third of all rows share makes one short list."""
    e = entities.where("value is not null and value != ''").groupBy("bridge_type", "value", "system").agg(F.max("id").alias("id"))
    g = e.groupBy("bridge_type", "value").agg(F.count(F.lit(1)).alias("n_systems"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "system", "id"))), "|").alias("members")).where("n_systems >= 2")
    return g.withColumn("confidence", _confidence(F.col("bridge_type"), F.col("n_systems")))


def coverage(entities: DataFrame, mapped: DataFrame) -> DataFrame:
    """(system, n_entities, n_mapped, coverage): entities with at least one bridge, by system."""
    on = entities.join(mapped.select("bridge_type", "value"), ["bridge_type", "value"], "left_semi").select("system", "id").distinct().withColumn("hit", F.lit(1))
    all_ = entities.select("system", "id").distinct()
    j = all_.join(on, ["system", "id"], "left").groupBy("system").agg(F.count(F.lit(1)).alias("n_entities"), F.count("hit").alias("n_mapped"))
    return j.withColumn("coverage", F.round(F.col("n_mapped") / F.col("n_entities"), 6))


def buckets(mapped: DataFrame) -> DataFrame:
    """(bucket, n): over 0.95 high, at least 0.7 medium, else low."""
    b = F.when(F.col("confidence") > 0.95, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    return mapped.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def unmapped(entities: DataFrame, mapped: DataFrame) -> DataFrame:
    on = entities.join(mapped.select("bridge_type", "value"), ["bridge_type", "value"], "left_semi").select("system", "id").distinct()
    return entities.select("system", "id").distinct().join(on, ["system", "id"], "left_anti")
