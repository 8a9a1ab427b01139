"""DDL scan: every CREATE TABLE of SQL texts as rows of tables, columns and foreign keys.

The statements are read by one tokenizer that knows quotes, comments and nesting, in Arrow batches.  Composite primary
keys are read as well as inline ones.  Texts without CREATE TABLE, null ones and statements that break off yield nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source string, table_name string, comment string, columns array<struct<name:string,type:string,comment:string,enum_values:array<string>,is_primary_key:boolean>>, foreign_keys array<struct<fk_column:string,ref_table:string,ref_column:string>>"
_TOKEN = re.compile(r"--[^\n]*|#[^\n]*|/\*.*?\*/|(?P<s>'(?:[^'\\]|''|\\.)*')|(?P<q>`[^`]*`|\"[^\"]*\")|(?P<w>[^\W]+)|(?P<o>[(),;.=])|(?P<x>\S)", re.S)


def _tokens(sql: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(sql):
        kind = m.lastgroup
        if kind == "s":
            out.append(("s", m.group()[1:-1].replace("''", "'")))
        elif kind == "q":
            out.append(("w", m.group()[1:-1]))
        elif kind:
            out.append((kind, m.group()))
    return out


def _is(t: tuple[str, str], *words: str) -> bool:
    return t[0] == "w" and t[1].upper() in words


def _split(tokens: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == ("o", "(")) - (t == ("o", ")"))
        if t == ("o", ",") and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _close(tokens: list[tuple[str, str]], i: int) -> int:
    depth = 0
    for j in range(i, len(tokens)):
        depth += (tokens[j] == ("o", "(")) - (tokens[j] == ("o", ")"))
        if depth == 0:
            return j
    return -1


def _names(part: list[tuple[str, str]], i: int) -> tuple[list[str], int]:
    j = _close(part, i)
    return [t[1] for t in part[i + 1 : j] if t[0] == "w"], j


def _column(part: list[tuple[str, str]]) -> dict:
    name, kind, i = part[0][1], part[1][1] if len(part) > 1 else "", 2
    enum: list[str] = []
    if i < len(part) and part[i] == ("o", "("):
        j = _close(part, i)
        inner = part[i + 1 : j]
        enum = [v for k, v in inner if k == "s"] if kind.upper() == "ENUM" else []
        kind += "(" + "".join("'" + v + "'" if k == "s" else v for k, v in inner) + ")"
        i = j + 1
    if i < len(part) and _is(part[i], "UNSIGNED"):
        kind += " " + part[i][1]
    rest = part[i:]
    comment = next((rest[k + 1][1] for k in range(len(rest) - 1) if _is(rest[k], "COMMENT") and rest[k + 1][0] == "s"), "")
    primary = any(_is(rest[k], "PRIMARY") and _is(rest[k + 1], "KEY") for k in range(len(rest) - 1))
    return {"name": name, "type": kind, "comment": comment, "enum_values": enum, "is_primary_key": primary}


def parse(sql: str) -> list[dict]:
    """Tables of a text."""
    t, out, i = _tokens(sql), [], 0
    while i < len(t) - 1:
        if not (_is(t[i], "CREATE") and _is(t[i + 1], "TABLE")):
            i += 1
            continue
        i += 2
        while i < len(t) and _is(t[i], "IF", "NOT", "EXISTS"):
            i += 1
        name = ""
        while i < len(t) and t[i] != ("o", "("):
            if t[i][0] != "w" and t[i][1] != "." or t[i] == ("o", ";"):
                break
            name = t[i][1] if t[i][0] == "w" else name
            i += 1
        if i >= len(t) or t[i] != ("o", "("):
            continue
        end = _close(t, i)
        if end < 0:  # breaks off: the next statement, if any, is read
            i += 1
            continue
        columns, keys, fks = [], set(), []
        for part in _split(t[i + 1 : end]):
            at = next((k for k in range(len(part)) if _is(part[k], "PRIMARY", "FOREIGN", "UNIQUE", "KEY", "INDEX", "CHECK", "CONSTRAINT")), None)
            if at == 0:
                if _is(part[0], "CONSTRAINT"):
                    at = next((k for k in range(1, len(part)) if _is(part[k], "PRIMARY", "FOREIGN", "UNIQUE", "CHECK")), 0)
                paren = next((k for k in range(at, len(part)) if part[k] == ("o", "(")), None)
                if paren is None:
                    continue
                names, j = _names(part, paren)
                if _is(part[at], "PRIMARY"):
                    keys |= set(names)
                elif _is(part[at], "FOREIGN") and j + 2 < len(part) and _is(part[j + 1], "REFERENCES"):
                    refs = _names(part, j + 3)[0] if j + 3 < len(part) and part[j + 3] == ("o", "(") else names
                    fks += [{"fk_column": a, "ref_table": part[j + 2][1], "ref_column": b} for a, b in zip(names, refs)]
            elif part[0][0] == "w":
                columns.append(_column(part))
                r = next((k for k in range(1, len(part) - 1) if _is(part[k], "REFERENCES")), None)
                if r is not None:
                    ref = _names(part, r + 2)[0] if r + 2 < len(part) and part[r + 2] == ("o", "(") else []
                    fks.append({"fk_column": part[0][1], "ref_table": part[r + 1][1], "ref_column": ref[0] if ref else part[0][1]})
        for c in columns:
            c["is_primary_key"] |= c["name"] in keys
        i, comment = end + 1, ""
        while i < len(t) and t[i] != ("o", ";") and not _is(t[i], "CREATE"):
            if _is(t[i], "COMMENT"):
                k = i + 1 + (i + 1 < len(t) and t[i + 1] == ("o", "="))
                if k < len(t) and t[k][0] == "s":
                    comment = t[k][1]
            i += 1
        out.append({"table_name": name, "comment": comment, "columns": columns, "foreign_keys": fks})
    return out


def tables(texts: DataFrame) -> DataFrame:
    """Parsed tables of texts (source, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"source": s, **t} for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x for t in parse(x)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return texts.select(F.col("source").cast("string"), "text").where(F.lower("text").contains("create")).mapInArrow(run, SCHEMA)


def columns(parsed: DataFrame) -> DataFrame:
    return parsed.select("source", "table_name", F.posexplode("columns").alias("pos", "c")).select("source", "table_name", "pos", F.col("c.name").alias("column_name"), F.col("c.type").alias("sql_type"), F.col("c.comment").alias("comment"), F.col("c.enum_values").alias("enum_values"), F.col("c.is_primary_key").alias("is_primary_key"))


def foreign_keys(parsed: DataFrame) -> DataFrame:
    return parsed.select("source", "table_name", F.explode("foreign_keys").alias("f")).select("source", "table_name", "f.fk_column", "f.ref_table", "f.ref_column")


def statements(tables: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """(table_name, statement): CREATE TABLE of tables (table_name, comment), columns (table_name, o, column_name, sql_type, comment, is_primary_key; in order of o and name) and fks (table_name, fk_column, ref_table), which refer to `id`."""
    quoted = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, r"\\\\", ""), "'", "''"), F.lit("'"))
    name = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    line = F.concat(name(F.col("column_name")), F.lit(" "), F.col("sql_type"), F.when(F.col("comment") != "", F.concat(F.lit(" COMMENT "), quoted(F.col("comment")))).otherwise(""))
    c = columns.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("o", "column_name", line.alias("line")))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("is_primary_key"), name(F.col("column_name"))))).alias("pk"))
    key = F.concat(F.lit("FOREIGN KEY ("), name(F.col("fk_column")), F.lit(") REFERENCES "), name(F.col("ref_table")), F.lit(" (`id`)"))
    k = fks.groupBy("table_name").agg(F.array_sort(F.collect_list(key)).alias("k"))
    j = tables.join(c, "table_name", "left").join(k, "table_name", "left")
    empty = F.array().cast("array<string>")
    pk = F.when(F.size("pk") > 0, F.array(F.concat(F.lit("PRIMARY KEY ("), F.array_join("pk", ", "), F.lit(")")))).otherwise(empty)
    body = F.array_join(F.concat(F.transform("c", lambda x: x["line"]), F.coalesce(pk, empty), F.coalesce("k", empty)), ",\n  ")
    return j.select("table_name", F.concat(F.lit("CREATE TABLE "), name(F.col("table_name")), F.lit(" (\n  "), body, F.lit("\n)"), F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" COMMENT="), quoted(F.col("comment")))).otherwise(""), F.lit(";")).alias("statement"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All DDL files under path."""
    return tables(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")))
