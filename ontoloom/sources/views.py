"""Markdown and Mermaid renderings of small result tables, and the JSON Schema of an ontology document.

A rendering is text for people: it is made of at most `most` rows, the first by name, and says if there were more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.sources.files import KINDS

REQUIRED = {"concepts": ["id", "name"], "properties": ["id", "name", "value_type"], "relations": ["id", "name"], "axioms": ["id", "axiom_type"], "taxonomy": []}
VALUE_TYPES = ["int", "float", "date", "string", "bool", "enum"]


def markdown(df: DataFrame, most: int = 200) -> str:
    rows = df.orderBy(*df.columns).limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows), f"\n{df.count()} rows"])


def _mermaid(head: str, df: DataFrame, line, most: int) -> str:
    lines = df.select(line.alias("x")).distinct().orderBy("x").limit(most + 1).toPandas().x
    return "\n".join([head, *lines[:most], *(["  %% more than shown"] if len(lines) > most else [])])


def class_lines(edges: DataFrame) -> DataFrame:
    """(line): all lines of the class diagram of edges (child, parent), for diagrams of any size that are written as text."""
    return edges.select(F.format_string("  `%s` <|-- `%s`", "parent", "child").alias("line")).distinct()


def class_diagram(edges: DataFrame, most: int = 200) -> str:
    """edges: child, parent."""
    return _mermaid("classDiagram", class_lines(edges), F.col("line"), most)


def flow_graph(relations: DataFrame, most: int = 200) -> str:
    """relations: name, domain, range."""
    return _mermaid("graph TD", relations, F.format_string("  %s -->|%s| %s", "domain", "name", "range"), most)


def er_diagram(relations: DataFrame, most: int = 200) -> str:
    """relations: name, domain, range, cardinality."""
    mark = F.when(F.col("cardinality") == "N:M", "}o--o{").when(F.col("cardinality") == "1:1", "||--||").otherwise("||--o{")
    return _mermaid("erDiagram", relations, F.format_string("  %s %s %s : %s", F.col("domain"), mark, F.col("range"), F.col("name")), most)


def json_schema() -> dict:
    """JSON Schema of the exported document."""
    item = lambda k: {"type": "object", "required": REQUIRED.get(k, [])}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": list(REQUIRED), "properties": {k: {"type": "array", "items": item(k)} for k in KINDS}}


def schema_violations(df: DataFrame, kind: str) -> DataFrame:
    """(kind, field, n): per check how many rows break it: required fields missing or null, value types outside the list."""
    checks = [(c, F.col(c).isNull() if c in df.columns else F.lit(True)) for c in REQUIRED.get(kind, [])]
    if "value_type" in df.columns:
        checks.append(("value_type:enum", ~F.col("value_type").isin(VALUE_TYPES)))
    if not checks:
        return df.sparkSession.createDataFrame([], "kind string, field string, n bigint")
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(str(i)) for i, (_, c) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("field"), F.col(str(i)).alias("n")) for i, (f, _) in enumerate(checks)])
    return one.select(F.explode(rows).alias("x")).select("x.*")
