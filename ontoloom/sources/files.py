"""Scans of documents, query logs, configuration and saved ontologies.  Everything that can be large is a DataFrame."""

from __future__ import annotations

import html.parser
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of rows of an ontology, each a table.
KINDS = "concepts properties relations taxonomy axioms rules semantic_annotations governance_rules glossary_terms external_mappings trigger_rules atomic_operations service_compositions permission_subjects permission_rules query_patterns".split()


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_text(page: str | None) -> str | None:
    """All text of a page, that of scripts and styles too, with entities decoded."""
    if page is None:
        return None
    p = _Text()
    p.feed(page)
    p.close()
    return "".join(p.parts).strip()


def pdf_text(content: bytes | None) -> str | None:
    """Text of a PDF where a reader is installed; null without one."""
    try:
        import io

        import pypdf
    except ImportError:
        return None
    return None if content is None else "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all txt, md, html and pdf files under path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))

    @F.pandas_udf("string")
    def text(kind: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([html_text(c.decode("utf-8", "replace")) if k == "html" else pdf_text(c) if k == "pdf" else c.decode("utf-8", "replace") for k, c in zip(kind, content)], dtype=object)

    return raw.where(kind.isin("txt", "md", "html", "pdf")).select("path", text(kind, "content").alias("text"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """(sql, frequency) of JSON lines: `sql`, else `query`, else the line itself; a line that isn't JSON is a query; blank lines are none."""
    lines = spark.read.text(path).where("trim(value) != ''")
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return lines.select(F.coalesce(get("sql"), get("query"), F.col("value")).alias("sql"), F.expr("try_cast(get_json_object(value, '$.frequency') as bigint)").alias("frequency"))


def config(path: str) -> dict:
    """A domain's YAML configuration; empty if the file is missing."""
    import yaml

    p = Path(path)
    return (yaml.safe_load(p.read_text(encoding="utf-8")) or {}) if p.exists() else {}


def config_tables(spark: SparkSession, conf: dict) -> dict[str, DataFrame]:
    """The configuration's lists as small tables: terms, concept and relation synonyms, table tags, mappings, subjects."""
    pairs = lambda key, std: [(a, x.get(std)) for x in conf.get(key) or [] for a in x.get("aliases") or []]
    return {
        "terms": spark.createDataFrame([(t,) for t in conf.get("business_terms") or []], "term string"),
        "concept_synonyms": spark.createDataFrame(pairs("concept_synonyms", "standard"), "alias string, standard string"),
        "relation_synonyms": spark.createDataFrame(pairs("relation_synonyms", "standard_name"), "alias string, standard string"),
        "table_tags": spark.createDataFrame(list((conf.get("system_table_tags") or {}).items()), "table_name string, tag string"),
        "mappings": spark.createDataFrame([(x.get("term"), x.get("uri") or x.get("external_uri")) for x in conf.get("external_mappings") or []], "term string, uri string"),
        "subjects": spark.createDataFrame([(x.get("name"), x.get("type"), x.get("parent")) for x in conf.get("permission_subjects") or []], "name string, type string, parent string"),
    }


def save_ontology(tables: dict[str, DataFrame], path: str) -> None:
    """Each kind as Parquet under path, none left out."""
    for k, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{k}")


def load_ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All kinds found under a path written by save_ontology, or in one JSON document that maps kinds to lists."""
    if path.endswith(".json"):
        doc = json.loads(Path(path).read_text(encoding="utf-8"))
        return {k: spark.read.json(spark.sparkContext.parallelize([json.dumps(x, ensure_ascii=False) for x in v])) for k, v in doc.items() if isinstance(v, list) and v and isinstance(v[0], dict)}
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return {k: spark.read.parquet(f"{path}/{k}") for k in KINDS if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{k}"))}


def load_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All kinds found under a path written by export_json."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    at = lambda k: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{k}")
    fs = at("").getFileSystem(conf)
    return {k: spark.read.json(f"{path}/{k}") for k in KINDS if fs.exists(at(k))}


def save_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines in one file; a report has a row per check, stage or table."""
    report.coalesce(1).write.mode("overwrite").json(path)


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """Each kind as JSON lines, written by the executors."""
    for k, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{k}")
