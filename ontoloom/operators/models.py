"""Steps that a language model may take part in.  Each asks a hook (ontoloom.hooks) and keeps only answers that hold; with the null hook none adds a row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.hooks import Hook, ask, null_hook, tolerant_json
from ontoloom.operators.schema_ops import RISK

#: Kinds of compositions; any other counts as the first.
COMPOSITIONS = ["sequential", "parallel", "conditional", "loop"]


def _parsed(answers: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(prompt_id, fields ...) of the objects in each answer's list `key`; fields: name to SQL type.  Objects without every field that isn't a number are dropped."""
    schema = "prompt_id string, " + ", ".join(f"{k} {t}" for k, t in fields.items())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, text in zip(p.prompt_id, p.answer):
                doc = tolerant_json(text)
                for x in (doc.get(key) if isinstance(doc, dict) else doc) or []:
                    if isinstance(x, dict) and all(x.get(k) not in (None, "") for k, t in fields.items() if t == "string"):
                        rows.append((i, *(str(x[k]) if t == "string" else pd.to_numeric(x.get(k), errors="coerce") for k, t in fields.items())))
            yield pd.DataFrame(rows, columns=["prompt_id", *fields])

    return answers.mapInPandas(run, schema)


def judge(links: DataFrame, concepts: DataFrame, hook: Hook = null_hook, sure: float = 0.85) -> DataFrame:
    """(a, b, cosine, linked): links (a, b, cosine) from `sure` on hold; of the others those that the hook answers with yes.  concepts: id, name."""
    name = lambda c: concepts.select(F.col("id").alias(c), F.col("name").alias(f"name_{c}")).dropDuplicates([c])
    open_ = links.where(F.col("cosine") < sure).join(name("a"), "a").join(name("b"), "b")
    prompts = open_.select(F.concat_ws("|", "a", "b").alias("prompt_id"), F.concat(F.lit("Do these name the same thing? Answer yes or no. "), "name_a", F.lit(" / "), "name_b").alias("prompt"))
    yes = ask(prompts, hook).where(F.lower(F.trim("answer")).rlike("^(yes|true|是)")).select("prompt_id", F.lit(True).alias("yes"))
    j = links.withColumn("prompt_id", F.concat_ws("|", "a", "b")).join(yes, "prompt_id", "left")
    return j.select("a", "b", "cosine", ((F.col("cosine") >= sure) | F.coalesce("yes", F.lit(False))).alias("linked"))


def text_concepts(chunks: DataFrame, hook: Hook = null_hook) -> DataFrame:
    """(name, span, confidence, n_docs): concepts that the hook names in chunks (doc_id, text) with a span; a span that isn't in its text is an invention and is dropped."""
    prompts = chunks.where("text is not null").select(F.col("doc_id").cast("string").alias("prompt_id"), F.concat(F.lit('List the business concepts of this text as {"concepts": [{"name", "span", "confidence"}]}. '), "text").alias("prompt"))
    got = _parsed(ask(prompts, hook), "concepts", {"name": "string", "span": "string", "confidence": "double"})
    true_ = got.join(chunks.select(F.col("doc_id").cast("string").alias("prompt_id"), "text"), "prompt_id").where(F.contains("text", "span"))
    return true_.groupBy("name").agg(F.min("span").alias("span"), F.max(F.coalesce("confidence", F.lit(0.8))).alias("confidence"), F.count_distinct("prompt_id").alias("n_docs"))


def text_triples(chunks: DataFrame, resolved: DataFrame, hook: Hook = null_hook) -> DataFrame:
    """(name, domain, range, confidence): relations that the hook reads in chunks (doc_id, text) whose ends are names or aliases of concepts.  resolved: ref, id."""
    prompts = chunks.where("text is not null").select(F.col("doc_id").cast("string").alias("prompt_id"), F.concat(F.lit('List the relations of this text as {"relations": [{"domain", "name", "range"}]}. '), "text").alias("prompt"))
    got = _parsed(ask(prompts, hook), "relations", {"domain": "string", "name": "string", "range": "string"})
    end = lambda c: resolved.select(F.col("ref").alias(c), F.col("id").alias(f"{c}_id"))
    return got.join(end("domain"), "domain").join(end("range"), "range").select("name", F.col("domain_id").alias("domain"), F.col("range_id").alias("range"), F.lit(0.7).alias("confidence")).distinct()


def text_axioms(relations: DataFrame, hook: Hook = null_hook, least: float = 0.7) -> DataFrame:
    """(axiom_type, subject, object, confidence): axioms of known kinds that the hook states for relations (name, domain, range) with a confidence of at least `least`."""
    prompts = relations.select("name", "domain", "range").distinct().select(F.concat_ws("|", "name", "domain", "range").alias("prompt_id"), F.concat(F.lit('List axioms as {"axioms": [{"axiom_type", "subject", "object", "confidence"}]} for the relation '), F.concat_ws(" ", "domain", "name", "range")).alias("prompt"))
    got = _parsed(ask(prompts, hook), "axioms", {"axiom_type": "string", "subject": "string", "object": "string", "confidence": "double"})
    return got.where(F.col("axiom_type").isin(list(RISK)) & (F.col("confidence") >= least)).groupBy("axiom_type", "subject", "object").agg(F.max("confidence").alias("confidence"))


def compositions(operations: DataFrame, hook: Hook = null_hook) -> DataFrame:
    """(name, composition_type, steps): services that the hook composes of operations (actor, name), one prompt an actor; unknown kinds count as sequential."""
    prompts = operations.groupBy("actor").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names")).where("actor is not null").select(F.col("actor").alias("prompt_id"), F.concat(F.lit('Compose services as {"services": [{"name", "composition_type", "steps"}]} of: '), "names").alias("prompt"))
    got = _parsed(ask(prompts, hook), "services", {"name": "string", "composition_type": "string", "steps": "string"})
    kind = F.when(F.col("composition_type").isin(COMPOSITIONS), F.col("composition_type")).otherwise(COMPOSITIONS[0])
    return got.select("name", kind.alias("composition_type"), "steps").distinct()
