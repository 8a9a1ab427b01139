"""Context of questions: the most relevant concepts, their surroundings, and both as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.text import ngrams, substrings


def relevance(questions: DataFrame, concepts: DataFrame, top: int = 20) -> DataFrame:
    """Top-k report: (question_id, id, score) of the `top` concepts per question, ties to the greatest id.

    A name in the question earns 5, each alias 3, a bigram shared with the description 1; names and aliases of two
    characters or more.  Names and aliases are joined with the question's substrings.  Of concepts that only share a
    bigram, the `top` greatest ids per bigram suffice, since at most `top` can enter a question's list."""
    q = questions.where("question is not null").select("question_id", "question")
    c = concepts.select("id", F.lower("name").alias("name"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower).alias("aliases"), F.array_distinct(ngrams(F.lower(F.coalesce("description", F.lit(""))), 2)).alias("g"))
    terms = c.select("id", F.col("name").alias("k"), F.lit(5).alias("w")).unionByName(c.select("id", F.explode("aliases").alias("k"), F.lit(3).alias("w"))).where("length(k) >= 2")
    subs = substrings(q, "question", terms).select("question_id", "k")
    named = subs.join(terms, "k").groupBy("question_id", "id").agg(F.sum("w").alias("w"))
    asked = q.select("question_id", F.array_distinct(ngrams(F.lower("question"), 2)).alias("qg"))
    shares = named.join(asked, "question_id").join(c.select("id", "g"), "id").select("question_id", "id", (F.col("w") + F.when(F.arrays_overlap("qg", "g"), 1).otherwise(0)).alias("score"))
    w = Window.partitionBy("b").orderBy(F.desc("id"))
    best = c.select("id", F.explode("g").alias("b")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("b", "id")
    weak = asked.select("question_id", F.explode("qg").alias("b")).join(best, "b").select("question_id", "id").distinct().join(named.select("question_id", "id"), ["question_id", "id"], "left_anti").withColumn("score", F.lit(1))
    every = shares.unionByName(weak.select("question_id", "id", "score"))
    r = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("id"))
    return every.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= top).select("question_id", "id", F.col("score").cast("bigint").alias("score"))


def surroundings(relevant: DataFrame, closure: DataFrame, below: int = 5, most: int = 40) -> DataFrame:
    """(question_id, id, how): relevant concepts, all their ancestors and the `below` nearest descendants of each, `most` per question in this order, ties by id."""
    own = relevant.select("question_id", "id", F.lit(0).alias("how"))
    up = relevant.select("question_id", F.col("id").alias("descendant")).join(closure, "descendant").select("question_id", F.col("ancestor").alias("id"), F.lit(1).alias("how"))
    asked = relevant.select(F.col("id").alias("ancestor")).distinct()
    near = closure.join(asked, "ancestor", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("ancestor").orderBy("distance", "descendant"))).where(F.col("r") <= below)
    down = relevant.select("question_id", F.col("id").alias("ancestor")).join(near, "ancestor").select("question_id", F.col("descendant").alias("id"), F.lit(2).alias("how"))
    one = own.unionByName(up).unionByName(down).groupBy("question_id", "id").agg(F.min("how").alias("how"))
    r = Window.partitionBy("question_id").orderBy("how", "id")
    return one.withColumn("r", F.row_number().over(r)).where(F.col("r") <= most).drop("r")


def as_text(slices: DataFrame, sections: list[DataFrame]) -> DataFrame:
    """(question_id, context): the lines of a slice's concepts, section after section in the order given, each sorted; a section has id and line.  A slice has at most some dozen concepts, so its text is short."""
    lines = None
    for o, df in enumerate(sections):
        part = slices.select("question_id", "id").join(df.select("id", "line").where("line is not null").distinct(), "id").select("question_id", F.lit(o).alias("o"), "line")
        lines = part if lines is None else lines.unionByName(part)
    g = lines.groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct("o", "line"))).alias("l"))
    return g.select("question_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))
