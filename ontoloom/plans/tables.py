"""Queries on profiles, links between systems and the query log, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.operators import linkage, profile, querylog
from ontoloom.session import table


def rdb_tables(spark, d):
    """Columns and tables of the relational source: a table is what source_ref names, its columns are the properties of the concepts found there."""
    c = table(spark, d, "onto_concept").where("source_ref like 'table:%'").select(F.col("id").alias("cid"), F.substring("source_ref", 7, 1000).alias("table_name"), "description").distinct()
    p = table(spark, d, "onto_property").select(F.lower(F.trim("domain_concept_id")).alias("cid"), F.col("name").alias("column_name"), F.col("name_cn").alias("comment"), "null_rate").distinct()
    r = table(spark, d, "onto_relation").select(F.lower(F.trim("domain_concept_id")).alias("cid")).distinct().withColumn("fk", F.lit(True))
    columns = c.join(p, "cid").select("table_name", "column_name", "comment", "null_rate")
    tables = c.join(r, "cid", "left").groupBy("table_name").agg(F.max("description").alias("comment"), F.coalesce(F.max("fk"), F.lit(False)).alias("has_fk"))
    return columns, tables


_RDB = """with c as (select distinct id cid, substring(source_ref, 7) table_name, description from onto_concept where source_ref like 'table:%'),
p as (select distinct lower(trim(domain_concept_id)) cid, name column_name, name_cn comment, null_rate from onto_property),
col as (select table_name, column_name, comment, null_rate from c join p using (cid)),
tab as (select table_name, max(description) comment, coalesce(bool_or(fk), false) has_fk from c left join (select distinct lower(trim(domain_concept_id)) cid, true fk from onto_relation) r using (cid) group by 1),
a as (select table_name, avg((not regexp_matches(lower(column_name), '^(c\\d|col\\d|field\\d|tmp_|f\\d)'))::int) named, avg((coalesce(comment, '') <> '')::int) commented, avg(null_rate) nulls from col group by 1),
s as (select table_name, least(10, case when not regexp_matches(lower(table_name), '^(tmp_|temp_|backup_|bak_|t\\d|test_|copy_)') then 3 else 0 end + case when named >= .8 then 2 when named >= .5 then 1 else 0 end
 + case when coalesce(tab.comment, '') <> '' and coalesce(commented, 0) >= .6 then 2 when coalesce(commented, 0) >= .3 then 1 else 0 end + case when nulls is null then 1 when nulls < .3 then 2 when nulls < .5 then 1 else 0 end + case when has_fk then 1 else 0 end) score
 from tab left join a using (table_name))
"""

_NULLABLE = ["name_en", "aliases", "description", "source_ref", "identity_spec", "properties"]
_SKEW = ["name", "value_type", "source", "nullable", "is_derived", "confidence"]
_SAMPLE = ["name_en", "description", "source_ref", "identity_spec"]


def entities(spark, d):
    """Concepts as entities of the systems that name them, bridged by code name and by table."""
    c = table(spark, d, "onto_concept").select(F.lower(F.trim("source")).alias("system"), "id", F.lower("name_en").alias("external_id"), F.substring_index("source_ref", ":", -1).alias("ref"))
    return c.unpivot(["system", "id"], ["external_id", "ref"], "bridge_type", "value").where("value is not null").distinct()


_ENT = """with e as (select distinct * from (select lower(trim(source)) as system, id, 'external_id' bridge_type, lower(name_en) as value from onto_concept union all select lower(trim(source)), id, 'ref', string_split(source_ref, ':')[-1] from onto_concept) where value is not null),
o as (select bridge_type, value, system, max(id) id from e where value <> '' group by all),
m as (select bridge_type, value, count(*) n_systems, array_to_string(list_sort(list(system || '=' || id)), '|') members from o group by 1, 2 having count(*) >= 2),
k as (select *, round(least(1.0, case bridge_type when 'external_id' then .85 else .8 end + .01 * (n_systems - 2)), 6) confidence from m)
"""


def _log(spark, d):
    return table(spark, d, "query_log")


_Q = r"[`\"'\[]?"
_TAB = querylog.TABLE.replace("'", "''")


def _p(x: str) -> str:
    return x.replace("'", "''")


_CLEAN = r"with l as (select log_id, lower(regexp_replace(sql, '[\s\x{00A0}\x{3000}]+', ' ', 'g')) q, coalesce(frequency, 1) w from query_log where sql is not null)"
_CRUD = f"{_CLEAN}, c as (select regexp_extract(q, '{_p(querylog.VERB)}', 1) verb, unnest(list_distinct(regexp_extract_all(q, '{_TAB}', 1))) table_name, w from l), crud as (select table_name, verb, count(*) n_queries, sum(w)::bigint as weight from c where verb <> '' group by all)"
_AGG = f"{_CLEAN}, x as (select regexp_extract_all(q, '{_p(querylog.AGG)}', 1) f, regexp_extract_all(q, '{_p(querylog.AGG)}', 2) c, trim(regexp_extract(q, '{_p(querylog.GROUP)}', 1)) g from l), y as (select f[i] f, c[i] c, g from (select *, unnest(range(1, len(f) + 1)) i from x)), agg as (select f as \"function\", c as column_name, g as group_by, count(*) as n_queries from y group by all)"

QUERIES = {
    "table_quality": lambda s, d: profile.table_scores(*rdb_tables(s, d)),
    "quality_filter": lambda s, d: profile.keep_by_quality(table(s, d, "onto_concept").select("id", "source_ref").distinct(), profile.table_scores(*rdb_tables(s, d))).select("id"),
    "null_triage": lambda s, d: profile.null_rates(table(s, d, "onto_concept"), _NULLABLE),
    "null_triage_stated": lambda s, d: table(s, d, "onto_property").where("null_rate is not null").groupBy(profile.triage(F.col("null_rate")).alias("triage")).agg(F.count(F.lit(1)).alias("n_rows")),
    "skew_all": lambda s, d: profile.skew(table(s, d, "onto_property"), _SKEW),
    "strat_sample": lambda s, d: profile.stratified_sample(table(s, d, "onto_concept").dropDuplicates(["id"]), "id", _SAMPLE, 100, 50),
    "system_tables": lambda s, d: table(s, d, "query_log").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit(r"from\s+([a-z0-9_]+)"), F.lit(1)))).alias("table_name")).distinct().select("table_name", profile.is_system(F.col("table_name")).alias("by_prefix"), profile.is_system_fk(F.col("table_name")).alias("by_word")),
    "bridge_map": lambda s, d: linkage.mapping(entities(s, d)),
    "bridge_coverage": lambda s, d: linkage.coverage(entities(s, d), linkage.mapping(entities(s, d))),
    "bridge_buckets": lambda s, d: linkage.buckets(linkage.mapping(entities(s, d))),
    "bridge_unmapped": lambda s, d: linkage.unmapped(entities(s, d), linkage.mapping(entities(s, d))),
    "crud_patterns": lambda s, d: querylog.crud(_log(s, d)),
    "filter_patterns": lambda s, d: querylog.filtered(_log(s, d)),
    "frequent_lookups": lambda s, d: querylog.lookups(_log(s, d)),
    "agg_patterns": lambda s, d: querylog.aggregates(_log(s, d)),
    "join_patterns": lambda s, d: querylog.joins(_log(s, d)),
    "data_gaps": lambda s, d: querylog.gaps(_log(s, d), table(s, d, "onto_property")),
    "index_suggest": lambda s, d: querylog.index_candidates(_log(s, d)),
    "derive_sql": lambda s, d: querylog.derivations(_log(s, d), table(s, d, "onto_property")),
}
_UNP = " union all ".join(f"select '{c}' as column_name, avg(({c} is null)::int) r from onto_concept" for c in _NULLABLE)
_SKEWSQL = " union all ".join(f"select '{c}' as column_name, lower({c}::varchar) as value from onto_property" if c in ("nullable", "is_derived") else f"select '{c}' as column_name, {c}::varchar as value from onto_property" for c in _SKEW)
_FILL = " + ".join(f"(coalesce({c}::varchar, '') <> '')::int" for c in _SAMPLE)
ORACLE = {
    "table_quality": _RDB + "select table_name, score, score >= 5 as should_process from s",
    "quality_filter": _RDB + "select id from (select distinct id, source_ref from onto_concept) k left join s on k.source_ref like '%table:%' and regexp_extract(k.source_ref, 'table:(\\w+)', 1) = s.table_name where coalesce(score >= 5, true)",
    "null_triage": f"select column_name, round(r, 6) as null_rate, case when r > .5 then 'ignored' when r > .3 then 'low_confidence' else 'normal' end as triage from ({_UNP})",
    "null_triage_stated": "select case when null_rate > .5 then 'ignored' when null_rate > .3 then 'low_confidence' else 'normal' end as triage, count(*) as n_rows from onto_property where null_rate is not null group by 1",
    "skew_all": f"with v as ({_SKEWSQL}), n as (select column_name, value, count(*) n from v where value is not null group by all) select column_name, arg_min(value, (-n, value)) as modal_value, round(max(n)::double / sum(n), 6) as share, max(n)::double / sum(n) >= .95 as skewed from n group by 1",
    "strat_sample": f"with r as (select id, any_value({_FILL}) f, md5(id) h from onto_concept group by id) (select id, 'filled' as stratum from r order by f desc, h limit 100) union all (select id, 'sparse' from r where f < .3 * {len(_SAMPLE)} order by h limit 50)",
    "system_tables": f"select distinct t as table_name, regexp_matches(t, '{profile.SYSTEM_TABLE}') as by_prefix, regexp_matches(t, '{profile.SYSTEM_WORD}') as by_word from (select unnest(regexp_extract_all(lower(sql), 'from\\s+([a-z0-9_]+)', 1)) t from query_log)",
    "bridge_map": _ENT + "select * from k",
    "bridge_coverage": _ENT + "select system, count(*) as n_entities, count(*) filter (where hit) as n_mapped, round((count(*) filter (where hit))::double / count(*), 6) as coverage from (select system, id, bool_or(m.value is not null) hit from e left join m using (bridge_type, value) group by 1, 2) group by 1",
    "bridge_buckets": _ENT + "select case when confidence > .95 then 'high' when confidence >= .7 then 'medium' else 'low' end as bucket, count(*) as n from k group by 1",
    "bridge_unmapped": _ENT + "select system, id from e left join m using (bridge_type, value) group by 1, 2 having not bool_or(m.value is not null)",
    "crud_patterns": _CRUD + " select * from crud",
    "filter_patterns": f"{_CLEAN}, c as (select regexp_extract(q, '{_TAB}', 1) table_name, trim(regexp_extract(q, '{_p(querylog.WHERE)}', 1)) as condition from l) select table_name, condition, count(*) as n_queries from c where table_name <> '' and condition <> '' group by 1, 2 having count(*) >= 2",
    "frequent_lookups": _CRUD + " select table_name, n_queries from crud where verb = 'select' and n_queries >= 2",
    "agg_patterns": _AGG + " select * from agg",
    "join_patterns": f"{_CLEAN}, t as (select list_sort(list_distinct(regexp_extract_all(q, '{_TAB}', 1))) t from l) select array_to_string(t, '|') as tables, case when len(t) > 3 then 'cross_source' else 'join_query' end as kind, count(*) as n_queries from t where len(t) >= 2 group by 1, 2",
    "data_gaps": f"{_CLEAN}, c as (select unnest(list_distinct(list_concat(regexp_extract_all(q, '{_p(querylog.GAP)}', 1), regexp_extract_all(q, '{_p(querylog.GAP_CALL)}', 1)))) column_name from l) select column_name, count(*) as n_queries from c where column_name in (select lower(name) from onto_property) group by 1",
    "index_suggest": f"{_CLEAN}, c as (select regexp_extract(q, '{_p(querylog.FIRST_COLUMN)}', 1) column_name from l union all select regexp_extract(q, '{_p(querylog.ORDER_COLUMN)}', 1) from l) select column_name, count(*) as n_queries from c where column_name <> '' group by 1 having count(*) >= 2 order by 2 desc, 1 limit 10",
    "derive_sql": _AGG + ", b as (select column_name, \"function\" f, sum(n_queries) n from agg where column_name in (select lower(name) from onto_property) group by 1, 2) select column_name as property_name, upper(arg_min(f, (-n, f))) || '(' || column_name || ')' as formula from b group by column_name",
}
