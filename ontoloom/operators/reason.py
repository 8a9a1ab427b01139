"""Deterministic reasoning in batches: every operator answers a table of questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.text import ngrams, substrings, trim
from ontoloom.session import cut


def resolve(refs: DataFrame, concepts: DataFrame) -> DataFrame:
    """(ref, id, how): a reference by id, else by name, else by alias; of several concepts the latest loaded, then the greatest id.

    concepts: id, name, aliases, loaded_at.  Null and blank references stay unresolved."""
    key = lambda c: F.lower(trim(c))
    names = concepts.select("id", "loaded_at", F.array(F.struct(key(F.col("id")).alias("k"), F.lit(1).alias("p")), F.struct(key(F.col("name")).alias("k"), F.lit(2).alias("p"))).alias("a"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.struct(key(x).alias("k"), F.lit(3).alias("p"))).alias("b"))
    long = names.select("id", "loaded_at", F.explode(F.concat("a", "b")).alias("x")).select("id", "loaded_at", "x.k", "x.p").where("k is not null and k != ''")
    best = long.groupBy("k").agg(F.min("p").alias("p"), F.max_by("id", F.struct(-F.col("p"), F.col("loaded_at"), F.col("id"))).alias("id"))
    j = refs.select("ref").distinct().withColumn("k", key(F.col("ref"))).join(best, "k", "left")
    return j.select("ref", "id", F.when(F.col("p") == 1, "id").when(F.col("p") == 2, "name").when(F.col("p") == 3, "alias").otherwise("unresolved").alias("how"))


def is_a(questions: DataFrame, sets: DataFrame) -> DataFrame:
    """(child, parent, answer, distance): by nested-set ranges, two key joins and no closure; a concept is itself (distance 0), unknown ones are null."""
    c = sets.select(F.col("concept_id").alias("child"), F.col("root_id").alias("cr"), F.col("lo").alias("cl"), F.col("depth").alias("cd"))
    p = sets.select(F.col("concept_id").alias("parent"), F.col("root_id").alias("pr"), F.col("lo").alias("pl"), F.col("hi").alias("ph"), F.col("depth").alias("pd"))
    j = questions.select("child", "parent").distinct().join(c, "child", "left").join(p, "parent", "left")
    known = F.col("cr").isNotNull() & F.col("pr").isNotNull()
    yes = known & (F.col("cr") == F.col("pr")) & F.col("cl").between(F.col("pl"), F.col("ph"))
    return j.select("child", "parent", F.when(known, yes).alias("answer"), F.when(yes, F.col("cd") - F.col("pd")).alias("distance"))


def inherited(closure: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, fact, origin, distance): what each node has itself (distance 0) and from its ancestors; facts: owner, fact; the nearest origin of a fact holds, ties to the least."""
    own = nodes.select("id").withColumn("origin", F.col("id")).withColumn("distance", F.lit(0))
    up = closure.select(F.col("descendant").alias("id"), F.col("ancestor").alias("origin"), "distance")
    j = own.unionByName(up).join(facts.select(F.col("owner").alias("origin"), "fact").distinct(), "origin")
    return j.groupBy("id", "fact").agg(F.min(F.struct("distance", "origin")).alias("m")).select("id", "fact", F.col("m.origin").alias("origin"), F.col("m.distance").alias("distance"))


def tagged(inherited_facts: DataFrame) -> DataFrame:
    """inherited() with `how`: the rule that a fact is proven by."""
    return inherited_facts.select("id", "fact", "origin", "distance", F.when(F.col("distance") == 0, "direct").otherwise("inheritance").alias("how"))


def proofs(questions: DataFrame, sets: DataFrame, ways: DataFrame) -> DataFrame:
    """(child, parent, answer, distance, proof): is_a with its steps from child to parent, one subclass link each; null without a positive answer.  ways: hierarchy.ways."""
    a = is_a(questions, sets)
    w = ways.select(F.col("concept_id").alias("child"), F.reverse("way").alias("up"))
    proof = F.when(F.col("answer"), F.array_join(F.slice("up", F.lit(1), F.col("distance") + 1), "→"))
    return a.join(w, "child", "left").select("child", "parent", "answer", "distance", proof.alias("proof"))


def names(facts: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """(key, alias): the sorted distinct values of each key, joined by '|'."""
    return facts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias(alias))


def lost_facts(edges: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, lost_<kind> ...): what the child of each link only has from above, by kind; facts: inherited()."""
    out = edges.select("child", "parent")
    for kind, inh in facts.items():
        out = out.join(names(inh.where("distance > 0").withColumnRenamed("id", "child"), "child", "fact", f"lost_{kind}"), "child", "left")
    return out.select("child", "parent", *[F.coalesce(f"lost_{k}", F.lit("")).alias(f"lost_{k}") for k in facts])


def gained_facts(links: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, gained_<kind> ...): what each child would have from a new parent that it lacks, by kind."""
    out = links.select("child", "parent").distinct()
    for kind, inh in facts.items():
        offer = out.select("child", "parent").join(inh.select(F.col("id").alias("parent"), "fact"), "parent")
        new = offer.join(inh.select(F.col("id").alias("child"), "fact"), ["child", "fact"], "left_anti")
        got = new.groupBy("child", "parent").agg(F.array_join(F.array_sort(F.collect_set("fact")), "|").alias(f"gained_{kind}"))
        out = out.join(got, ["child", "parent"], "left")
    return out.select("child", "parent", *[F.coalesce(f"gained_{k}", F.lit("")).alias(f"gained_{k}") for k in facts])


#: What answers a question of a category; others are described.
ROUTES = {"subclass": "is_a", "subclass_transitive": "is_a", "relation_inheritance": "relations", "permission": "relations", "subclass_relation": "relations", "derived_property": "derived"}


def dispatch(questions: DataFrame, mentioned: DataFrame, sets: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """(question_id, route, concept_id, answer) of questions (question_id, category), by the concepts they mention (question_id, rank, id) alone: is_a asks whether the first lies below the second; other routes give the list of that name (id, answer) of the first; no mention or list, no answer."""
    route = F.coalesce(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])[F.col("category")], F.lit("describe"))
    first = mentioned.where("rank = 1").select("question_id", F.col("id").alias("concept_id"))
    second = mentioned.where("rank = 2").select("question_id", F.col("id").alias("other"))
    q = questions.select("question_id", route.alias("route")).join(first, "question_id", "left").join(second, "question_id", "left")
    yes = is_a(q.where("route = 'is_a' and other is not null").select(F.col("concept_id").alias("child"), F.col("other").alias("parent")), sets).select(F.col("child").alias("concept_id"), F.col("parent").alias("other"), F.lit("is_a").alias("route"), F.when(F.col("answer"), "是").when(~F.col("answer"), "否").alias("said"))
    listed = None
    for name, df in lists.items():
        part = df.select(F.col("id").alias("concept_id"), F.lit(name).alias("route"), F.col("answer").alias("listed"))
        listed = part if listed is None else listed.unionByName(part)
    j = q.join(yes, ["concept_id", "other", "route"], "left").join(listed, ["concept_id", "route"], "left")
    return j.select("question_id", "route", "concept_id", F.coalesce("said", "listed").alias("answer"))


def check_constraints(relations: DataFrame, declared: DataFrame, sets: DataFrame) -> DataFrame:
    """(relation_id, domain_ok, range_ok, confidence): domain and range must be subclasses of those declared for the relation's name (name, domain, range); a side that isn't declared or known passes."""
    r = relations.join(declared.select("name", F.col("domain").alias("dd"), F.col("range").alias("dr")), "name")
    ask = r.select(F.col("domain").alias("child"), F.col("dd").alias("parent")).unionByName(r.select(F.col("range").alias("child"), F.col("dr").alias("parent"))).where("child is not null and parent is not null")
    a = is_a(ask, sets).select("child", "parent", "answer")
    d = r.join(a.select(F.col("child").alias("domain"), F.col("parent").alias("dd"), F.col("answer").alias("domain_ok")), ["domain", "dd"], "left")
    x = d.join(a.select(F.col("child").alias("range"), F.col("parent").alias("dr"), F.col("answer").alias("range_ok")), ["range", "dr"], "left")
    ok = lambda c: F.coalesce(c, F.lit(True))
    return x.select("relation_id", ok(F.col("domain_ok")).alias("domain_ok"), ok(F.col("range_ok")).alias("range_ok"), F.when(ok(F.col("domain_ok")) & ok(F.col("range_ok")), 1.0).otherwise(0.3).alias("confidence"))


def fire(events: DataFrame, triggers: DataFrame, least_overlap: int = 1) -> DataFrame:
    """(event, trigger): triggers (name, text) that share at least least_overlap distinct character bigrams with an event's text (event, text); joined on bigrams, each side without repeats."""
    g = lambda df, k: df.select(k, F.explode(F.array_distinct(ngrams(F.lower("text"), 2))).alias("g"))
    j = g(events, "event").join(g(triggers.withColumnRenamed("name", "trigger"), "trigger"), "g")
    return j.groupBy("event", "trigger").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least_overlap).select("event", "trigger")


def lineage(properties: DataFrame) -> DataFrame:
    """(property_id, source_name, n_sources): names in the formula of a derived property that are properties of the same concept; properties: id, owner, name, formula."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("formula"), F.lit(r"([a-z_][a-z0-9_]*)"), F.lit(1)))
    used = properties.where("formula is not null").select("id", "owner", F.explode(words).alias("source_name"))
    own = properties.groupBy("owner", F.lower("name").alias("source_name")).agg(F.count_distinct("id").alias("n_sources"))
    return used.join(own, ["owner", "source_name"]).select(F.col("id").alias("property_id"), "source_name", "n_sources")


def remove_subclass(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(child, parent, lost_ancestors, affected): for each edge asked, what the child loses and how many nodes below lose it too."""
    s = sets.select(F.col("concept_id").alias("child"), F.col("depth"), "n_descendants")
    return edges.select("child", "parent").join(s, "child").select("child", "parent", F.col("depth").cast("bigint").alias("lost_ancestors"), (F.col("n_descendants") + 1).alias("affected"))


def add_subclass(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(child, parent, outcome, gained): ancestors that each child would gain, none if the link holds already, and `cycle` if the parent lies below the child."""
    a = is_a(edges, sets).select("child", "parent", "answer")
    b = is_a(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), sets).select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.col("answer").alias("below"))
    depth = sets.select(F.col("concept_id").alias("parent"), F.col("root_id").alias("pr"), F.col("depth").alias("pd"))
    j = a.join(b, ["child", "parent"]).join(depth, "parent", "left")
    outcome = F.when(F.col("answer").isNull(), "unknown").when(F.col("answer"), "already").when(F.col("below"), "cycle").otherwise("gains")
    return j.select("child", "parent", outcome.alias("outcome"), F.when(outcome == "gains", F.col("pd") + 1).otherwise(0).cast("bigint").alias("gained"))


def remove_relation(facts: DataFrame, sets: DataFrame) -> DataFrame:
    """(fact, n_direct, n_affected): per relation name the concepts that have it and those that have or inherit it; owners below another owner aren't counted twice.

    Ranges of owners are made disjoint by one ordered scan per root and fact: a range inside one begun before adds nothing."""
    own = facts.select("owner", "fact").distinct().join(sets.select(F.col("concept_id").alias("owner"), "root_id", "lo", "hi"), "owner")
    w = Window.partitionBy("fact", "root_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    top = own.withColumn("before", F.max("hi").over(w)).withColumn("outer", F.col("before").isNull() | (F.col("lo") > F.col("before")))
    return top.groupBy("fact").agg(F.count(F.lit(1)).alias("n_direct"), F.sum(F.when(F.col("outer"), F.col("hi") - F.col("lo") + 1).otherwise(0)).alias("n_affected"))


def remove_concept(concepts: DataFrame, edges: DataFrame, relations: DataFrame, properties: DataFrame) -> DataFrame:
    """(id, orphan_children, broken_relations, lost_properties) of each concept; a relation of a concept with itself breaks once."""
    kids = edges.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("orphan_children"))
    ends = relations.select("relation_id", F.explode(F.array_distinct(F.array("domain", "range"))).alias("id")).where("id is not null")
    broken = ends.groupBy("id").agg(F.count(F.lit(1)).alias("broken_relations"))
    lost = properties.groupBy(F.col("owner").alias("id")).agg(F.count(F.lit(1)).alias("lost_properties"))
    j = concepts.select("id").join(kids, "id", "left").join(broken, "id", "left").join(lost, "id", "left")
    return j.fillna(0, ["orphan_children", "broken_relations", "lost_properties"])


def describe(concepts: DataFrame, sets: DataFrame, properties: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, name, depth, n_descendants, properties, relations): own properties and relations as sorted lists of names."""
    p = properties.groupBy(F.col("owner").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("properties"))
    r = relations.groupBy(F.col("domain").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("relations"))
    s = sets.select(F.col("concept_id").alias("id"), F.col("depth").cast("bigint").alias("depth"), "n_descendants")
    return concepts.select("id", "name").join(s, "id", "left").join(p, "id", "left").join(r, "id", "left").select("id", "name", "depth", "n_descendants", F.coalesce("properties", F.lit("")).alias("properties"), F.coalesce("relations", F.lit("")).alias("relations"))


def mentioned(questions: DataFrame, concepts: DataFrame, most: int = 2) -> DataFrame:
    """(question_id, rank, id): the `most` longest concept names of each question, ties by name; of equal names the least id.  concepts: id, name."""
    n = cut(concepts.select(F.lower("name").alias("k"), "name", "id").where("length(name) >= 2").groupBy("k").agg(F.min("name").alias("name"), F.min("id").alias("id")))
    hit = substrings(questions.select("question_id", "question"), "question", n).select("question_id", "k").join(n, "k")
    w = Window.partitionBy("question_id").orderBy(F.desc(F.length("name")), "name")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("question_id", "rank", "id")


def mentions(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(question_id, name): the longest concept name in each question, ties to the least; substrings are joined on equality, not compared pairwise."""
    names = cut(concepts.select(F.lower("name").alias("k"), "name").where("length(name) >= 2").groupBy("k").agg(F.min("name").alias("name")))
    rows = substrings(questions.select("question_id", "question"), "question", names).select("question_id", "k")
    j = rows.join(names, "k")
    return j.groupBy("question_id").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("name"))
