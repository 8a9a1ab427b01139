"""Query-log analytics by pattern.  Null texts yield nothing; `weight` counts a query as often as its frequency says (null as once)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "[A-Za-z0-9_]+"
Q = r"[`\"'\[]?"
TABLE = rf"(?i)(?:from|into|update|join)\s+{Q}({W})"
#: Patterns of the statement's verb, its filter, aggregates, groups and gaps.
VERB = r"(?i)^\s*(select|insert|update|delete)\s"
WHERE = r"(?i)\bwhere\s+(.+?)(?:\s+group\s+by\b|\s+order\s+by\b|\s+limit\b|\s+having\b|[\s;]*$)"
AGG = rf"(?i)\b(sum|count|avg|max|min)\s*\(\s*{Q}({W})"
GROUP = r"(?i)\bgroup\s+by\s+(.+?)(?:\s+order\s+by\b|\s+limit\b|\s+having\b|[\s;]*$)"
GAP = rf"(?i)(?:{Q}({W})[`\"'\]]?\s+is\s+(?:not\s+)?null)"
GAP_CALL = rf"(?i)\b(?:coalesce|ifnull|isnull)\s*\(\s*(?:[a-z]\.)?{Q}({W})"
FIRST_COLUMN = rf"(?i)\bwhere\s+\(?(?:[a-z]\.)?{Q}({W})[`\"'\]]?\s*(?:=|<|>|like\b|is\b|in\b)"
ORDER_COLUMN = rf"(?i)\border\s+by\s+(?:[a-z]\.)?{Q}({W})"


def clean(log: DataFrame) -> DataFrame:
    """(log_id, q, w): lower-case text with plain blanks."""
    q = F.lower(F.regexp_replace("sql", r"[\s 　]+", " "))
    return log.where("sql is not null").select("log_id", q.alias("q"), F.coalesce(F.col("frequency"), F.lit(1)).alias("w"))


def _all(pattern: str, g: int = 1) -> Column:
    return F.array_distinct(F.regexp_extract_all("q", F.lit(pattern), F.lit(g)))


def crud(log: DataFrame) -> DataFrame:
    """(table_name, verb, n_queries, weight)."""
    c = clean(log).select(F.regexp_extract("q", VERB, 1).alias("verb"), F.explode(_all(TABLE)).alias("table_name"), "w").where("verb != ''")
    return c.groupBy("table_name", "verb").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("w").alias("weight"))


def filtered(log: DataFrame, least: int = 2) -> DataFrame:
    """(table_name, condition, n_queries): conditions by table of the statement's first table, found at least `least` times."""
    c = clean(log).select(F.regexp_extract("q", TABLE, 1).alias("table_name"), F.trim(F.regexp_extract("q", WHERE, 1)).alias("condition")).where("table_name != '' and condition != ''")
    return c.groupBy("table_name", "condition").agg(F.count(F.lit(1)).alias("n_queries")).where(F.col("n_queries") >= least)


def lookups(log: DataFrame, least: int = 2) -> DataFrame:
    """(table_name, n_queries): tables selected from at least `least` times."""
    return crud(log).where("verb = 'select'").where(F.col("n_queries") >= least).select("table_name", "n_queries")


def aggregates(log: DataFrame) -> DataFrame:
    """(function, column_name, group_by, n_queries)."""
    pairs = F.arrays_zip(F.regexp_extract_all("q", F.lit(AGG), F.lit(1)).alias("f"), F.regexp_extract_all("q", F.lit(AGG), F.lit(2)).alias("c"))
    c = clean(log).select(F.explode(pairs).alias("p"), F.trim(F.regexp_extract("q", GROUP, 1)).alias("group_by"))
    return c.groupBy(F.col("p.f").alias("function"), F.col("p.c").alias("column_name"), "group_by").agg(F.count(F.lit(1)).alias("n_queries"))


def joins(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(tables, kind, n_queries): sets of tables read together, of those that `known` (table_name) has if given; over three are cross_source."""
    t = F.array_sort(_all(TABLE))
    c = clean(log).select(t.alias("t")).where(F.size("t") >= 2)
    if known is not None:
        sets = c.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        hit = sets.select("t", "n", F.explode("t").alias("table_name")).join(known.select(F.lower("table_name").alias("table_name")).distinct(), "table_name")
        c = hit.groupBy("t", "n").agg(F.array_sort(F.collect_list("table_name")).alias("k")).where(F.size("k") >= 2).select(F.col("k").alias("t"), "n")
        return c.groupBy(F.array_join("t", "|").alias("tables"), F.when(F.size("t") > 3, "cross_source").otherwise("join_query").alias("kind")).agg(F.sum("n").alias("n_queries"))
    return c.groupBy(F.array_join("t", "|").alias("tables"), F.when(F.size("t") > 3, "cross_source").otherwise("join_query").alias("kind")).agg(F.count(F.lit(1)).alias("n_queries"))


def gaps(log: DataFrame, properties: DataFrame) -> DataFrame:
    """(column_name, n_queries): columns tested for null, or given a value instead, that are names of properties."""
    c = clean(log).select(F.explode(F.array_union(_all(GAP), _all(GAP_CALL))).alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_queries"))
    return c.join(properties.select(F.lower("name").alias("column_name")).distinct(), "column_name", "left_semi")


def index_candidates(log: DataFrame, top: int = 10, least: int = 2) -> DataFrame:
    """Top-k report: (column_name, n_queries) of the columns filtered first or sorted by first; ties by name."""
    cols = F.array_compact(F.array(F.nullif(F.regexp_extract("q", FIRST_COLUMN, 1), F.lit("")), F.nullif(F.regexp_extract("q", ORDER_COLUMN, 1), F.lit(""))))
    c = clean(log).select(F.explode(cols).alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_queries"))
    return c.where(F.col("n_queries") >= least).orderBy(F.desc("n_queries"), "column_name").limit(top)


def operations(log: DataFrame, concepts: DataFrame) -> DataFrame:
    """(name, concept_name, n_queries): verb and concept, for tables that are English names of concepts; of equal names the least concept id holds."""
    word = F.create_map(*[F.lit(x) for x in ("select", "查询", "insert", "创建", "update", "更新", "delete", "删除")])
    by_name = concepts.select(F.lower("name_en").alias("table_name"), "name", "id").where("table_name is not null").groupBy("table_name").agg(F.min_by("name", "id").alias("concept_name"))
    j = crud(log).join(by_name, "table_name")
    return j.select(F.concat(word[F.col("verb")], "concept_name").alias("name"), "concept_name", "n_queries").groupBy("name", "concept_name").agg(F.sum("n_queries").alias("n_queries"))


def derivations(log: DataFrame, properties: DataFrame) -> DataFrame:
    """(property_name, formula): the first aggregate over each known property, by function name."""
    a = aggregates(log).join(properties.select(F.lower("name").alias("column_name")).distinct(), "column_name", "left_semi")
    best = a.groupBy("column_name", "function").agg(F.sum("n_queries").alias("n")).groupBy("column_name").agg(F.min_by("function", F.struct(-F.col("n"), F.col("function"))).alias("f"))
    return best.select(F.col("column_name").alias("property_name"), F.concat(F.upper("f"), F.lit("("), "column_name", F.lit(")")).alias("formula"))
