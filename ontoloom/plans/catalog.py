"""All core queries by name."""

from __future__ import annotations

from ontoloom.plans import answers, reasoning, records, schemas, tables, texts

_PARTS = [records, texts, tables, reasoning, schemas, answers]
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
#: Columns whose SQL type differs from the query's (literals are decimals there, counts of rounds plain integers).
_CASTS = {
    "double": {"cn_phrases": ["confidence"], "text_concepts": ["confidence"], "bridge_map": ["confidence"], "constraint_check": ["confidence"], "fk_filter": ["confidence"], "substring_hierarchy": ["confidence"], "valid_types": ["max_value", "min_value"]},
    "integer": {"doc_quality": ["length"], "closure_taxonomy": ["distance"]},
    "bigint": {"relevant_slice": ["how"], "triggers_swrl": ["rule_id"], "closure_geo": ["distance"], "inherited_relations_geo": ["nearest"], "cf_remove_subclass": ["lost_ancestors"], "cf_add_subclass": ["gained"], "describe_concept": ["depth"], "consistency_rule_vars": ["rule_id"], "consistency_rule_cycles": ["a", "b"], "swrl_parse": ["rule_id"], "message_inbox": ["pos"]},
}
_BY_QUERY = {q: {c: t for c in cs} for t, qs in _CASTS.items() for q, cs in qs.items()}


def _cast(name: str, sql: str) -> str:
    casts = ", ".join(f"cast({c} as {t}) as {c}" for c, t in _BY_QUERY.get(name, {}).items())
    return f"select * replace ({casts}) from ({sql})" if casts else sql


ORACLE = {k: _cast(k, v) for p in _PARTS for k, v in p.ORACLE.items()}
FLAGSHIP = reasoning.inherited_geo
