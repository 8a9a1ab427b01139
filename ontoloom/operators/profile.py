"""Profiling and quality: table scores, null triage, skew, stratified sample, system tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of throw-away tables and columns, and of system tables.
JUNK_TABLE = r"^(tmp_|temp_|backup_|bak_|t\d|test_|copy_)"
JUNK_COLUMN = r"^(c\d|col\d|field\d|tmp_|f\d)"
SYSTEM_TABLE = r"^(tmp_|temp_|backup_|system_|log_|audit_|session_|cache_)"
SYSTEM_WORD = "log|audit|session|cache|tmp|backup|temp"


def is_system(table: Column) -> Column:
    """By prefix, for concepts."""
    return F.lower(table).rlike(SYSTEM_TABLE)


def is_system_fk(table: Column, tag: Column | None = None) -> Column:
    """By tag or by any system word in the name, for foreign keys."""
    word = F.lower(table).rlike(SYSTEM_WORD)
    return word if tag is None else F.coalesce(tag == "system", F.lit(False)) | word


def table_scores(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, score, should_process): 0 to 10.

    columns: table_name, column_name, comment, null_rate; tables: table_name, comment, has_fk.  A table without columns
    counts as uncommented; an unknown null rate earns one point; the scan of columns is one map-side aggregation."""
    c = columns.groupBy("table_name").agg(F.avg((~F.lower("column_name").rlike(JUNK_COLUMN)).cast("double")).alias("named"), F.avg((F.coalesce("comment", F.lit("")) != "").cast("double")).alias("commented"), F.avg("null_rate").alias("nulls"))
    j = tables.join(c, "table_name", "left")
    has_comment = F.coalesce(F.col("comment"), F.lit("")) != ""
    points = (
        F.when(~F.lower("table_name").rlike(JUNK_TABLE), 3).otherwise(0)
        + F.when(F.col("named") >= 0.8, 2).when(F.col("named") >= 0.5, 1).otherwise(0)
        + F.when(has_comment & (F.coalesce("commented", F.lit(0.0)) >= 0.6), 2).when(F.coalesce("commented", F.lit(0.0)) >= 0.3, 1).otherwise(0)
        + F.when(F.col("nulls").isNull(), 1).when(F.col("nulls") < 0.3, 2).when(F.col("nulls") < 0.5, 1).otherwise(0)
        + F.when(F.col("has_fk"), 1).otherwise(0)
    )
    s = F.least(points, F.lit(10))
    return j.select("table_name", s.alias("score"), (s >= 5).alias("should_process"))


def null_rates(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, null_rate, triage) of all columns in one pass: over 0.5 ignored, over 0.3 low_confidence; null for an empty table."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "null_rate").select("column_name", F.round("null_rate", 6).alias("null_rate"), triage(F.col("null_rate")).alias("triage"))


def triage(rate: Column) -> Column:
    return F.when(rate > 0.5, "ignored").when(rate > 0.3, "low_confidence").otherwise("normal")


def skew(df: DataFrame, cols: list[str], threshold: float = 0.95) -> DataFrame:
    """(column_name, modal_value, share, skewed): the most frequent non-null value of each column, ties to the least; all columns in one aggregation over (column, value)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "value").where("value is not null")
    n = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("modal_value"), (F.max("n") / F.sum("n")).alias("share"))
    return top.select("column_name", "modal_value", F.round("share", 6).alias("share"), (F.col("share") >= threshold).alias("skewed"))


def usable_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, triage, modal_value, share, skewed): skew of the columns that nulls don't rule out; a column without values has no row."""
    rates = null_rates(df, cols).where("triage != 'ignored'").select("column_name", "triage")
    kept = [r.column_name for r in rates.collect()]  # as many as the columns asked for
    if not kept:
        return rates.join(skew(df.limit(0), cols), "column_name").select("column_name", "triage", "modal_value", "share", "skewed")
    return rates.join(skew(df, kept), "column_name").select("column_name", "triage", "modal_value", "share", "skewed")


def stratified_sample(df: DataFrame, key: str, cols: list[str], full: int = 1000, sparse: int = 100) -> DataFrame:
    """A sampling operator: (key, stratum) of the `full` rows with most filled columns and of `sparse` rows with under 30 % filled.

    Ties and the second stratum are ordered by the MD5 of the key, so the sample is reproducible; a top-k per partition precedes the final one."""
    filled = reduce(lambda a, b: a + b, [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in cols])
    rows = df.select(key, filled.alias("filled")).withColumn("h", F.md5(F.col(key).cast("string")))
    first = rows.orderBy(F.desc("filled"), "h").limit(full).select(key, F.lit("filled").alias("stratum"))
    second = rows.where(F.col("filled") < 0.3 * len(cols)).orderBy("h").limit(sparse).select(key, F.lit("sparse").alias("stratum"))
    return first.unionByName(second)


def keep_by_quality(concepts: DataFrame, scores: DataFrame) -> DataFrame:
    """Concepts whose table passed or is unknown; only refs that name a table count."""
    t = F.when(F.col("source_ref").contains("table:"), F.regexp_extract("source_ref", r"table:(\w+)", 1))
    j = concepts.withColumn("table_name", t).join(scores.select("table_name", "should_process"), "table_name", "left")
    return j.where(F.coalesce("should_process", F.lit(True))).drop("table_name", "should_process")
