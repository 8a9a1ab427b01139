"""Queries of the llm problems for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontoloom.llm import entities, format_dups, mixing, pairs, tokens, toxicity
from ontoloom.session import cut, table


def p3_found(spark, d):
    return format_dups.found(table(spark, d, "query_log"))


def p3_queries(spark, d):
    return format_dups.collapse(table(spark, d, "query_log"))


def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def _mix(spark, d):
    sizes = mixing.sized(table(spark, d, "documents"))
    return sizes, mixing.plan(sizes, table(spark, d, "mix_target"))


def p8_mix(spark, d):
    return mixing.mix(*_mix(spark, d))


def p8_shares(spark, d):
    return mixing.shares(*_mix(spark, d))


def p4_found(spark, d):
    return entities.found(table(spark, d, "onto_concept"))


def p4_matches(spark, d):
    m = entities.match(table(spark, d, "onto_concept"))
    return m.withColumn("confidence", F.round("confidence", 4))


def p5_found(spark, d):
    return pairs.defects(table(spark, d, "qa_dataset"), table(spark, d, "condition_result"))


def p5_rates(spark, d):
    return p5_found(spark, d).groupBy("pair_table", "defect").agg(F.count(F.lit(1)).alias("n_pairs"))


def p9_found(spark, d):
    return toxicity.found(table(spark, d, "documents"), table(spark, d, "toxicity_labels"))


def p9_scores(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.passages(cut(toxicity.scored(docs, table(spark, d, "toxicity_labels"))), docs)


def p9_rates(spark, d):
    return toxicity.rates(toxicity.scored(table(spark, d, "documents"), table(spark, d, "toxicity_labels")))


QUERIES = {"p3_found": p3_found, "p3_queries": p3_queries, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p5_rates": p5_rates, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
#: These problems need canonical parsing, learned models or tokenizers, which SQL can't express; tests/llm holds brute-force, round-trip and held-out checks.
ORACLE: dict[str, str] = {}
