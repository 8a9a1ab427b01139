"""Chunking, sections and quality of documents.  Null texts make no chunk and no section; they score 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import trim

HEADING = r"^(#{1,6})[ \t]+(.+)$"


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def by_sections(text: Column) -> Column:
    """Pieces that begin at headings."""
    return _pieces(F.split(F.regexp_replace(text, r"\n(#{1,6}\s)", "\u0001$1"), "\u0001"))


def by_paragraphs(text: Column) -> Column:
    return _pieces(F.split(text, "\n\n"))


def by_window(text: Column, window: int = 800, overlap: int = 200) -> Column:
    """Windows of fixed width; the last is the first that reaches the end."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and less than window")
    step = window - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - window) / step)).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(window)))).otherwise(F.array().cast("array<string>"))


def auto(text: Column) -> Column:
    """Sections if there are several, else paragraphs if there are several, else windows."""
    sections, paragraphs = by_sections(text), by_paragraphs(text)
    return F.when(text.rlike(r"(?m)^#{1,6}\s") & (F.size(sections) > 1), sections).when(F.size(paragraphs) > 1, paragraphs).otherwise(by_window(text))


STRATEGIES = {"sections": by_sections, "paragraphs": by_paragraphs, "window": by_window, "auto": auto}


def chunk(docs: DataFrame, strategy: str = "auto") -> DataFrame:
    """(doc_id, pos, chunk)."""
    return docs.where("text is not null").select("doc_id", F.posexplode(STRATEGIES[strategy](F.col("text"))).alias("pos", "chunk"))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, content): text under each heading up to the next; a text without headings is one section without title."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col("text")), r"\n(#{1,6})[ \t]+([^\n]+)", "\u0001$1\u0002$2\u0003")
    parts = F.split(marked, "\u0001")
    rows = docs.where("text is not null").select("doc_id", "text", F.posexplode(parts).alias("pos", "part"))
    level = F.length(F.substring_index("part", "\u0002", 1))
    rest = F.substring_index("part", "\u0002", -1)
    headed = rows.where("pos > 0").select("doc_id", F.col("pos"), level.alias("level"), trim(F.substring_index(rest, "\u0003", 1)).alias("title"), trim(F.substring_index(rest, "\u0003", -1)).alias("content"))
    bare = docs.where("text is not null").where(~F.concat(F.lit("\n"), F.col("text")).rlike(r"\n#{1,6}[ \t]+[^\n]")).select("doc_id", F.lit(1).alias("pos"), F.lit(0).alias("level"), F.lit("").alias("title"), trim("text").alias("content"))
    return headed.unionByName(bare)


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, length, has_content, has_structure, printable_ratio)."""
    n = F.length("text")
    printable = F.length(F.regexp_replace("text", r"[\p{C}\p{Z}]", "")) + F.length(F.regexp_replace("text", r"[^ \t\n\r]", ""))
    return docs.select("doc_id", F.coalesce(n, F.lit(0)).alias("length"), (F.coalesce(n, F.lit(0)) > 100).alias("has_content"), F.coalesce(F.concat(F.lit("\n"), F.col("text")).rlike(r"\n#{1,6}[ \t]+[^\n]"), F.lit(False)).alias("has_structure"), F.round(F.coalesce(printable / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("printable_ratio"))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, score): 0 to 10 by length and structure."""
    q = quality(docs)
    points = F.when(F.col("length") > 500, 4).when(F.col("length") > 100, 2).otherwise(0) + F.when(F.col("has_structure"), 3).otherwise(0) + F.when(F.col("length") > 2000, 2).otherwise(0) + F.when(F.col("length") > 5000, 1).otherwise(0)
    return q.select("doc_id", F.least(points, F.lit(10)).alias("score"))
