"""Graph primitives on edge tables: closure, components, cycle removal, levels, bounded paths.  Null ends are no edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.operators import hierarchy
from ontoloom.session import cut, discard


def tree_closure(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(descendant, ancestor, distance) of a taxonomy's tree nodes, or of those in `of` (id), the node itself left out: their paths exploded, so the work is the size of the result."""
    ways = hierarchy.shared_ways(nodes)
    if of is not None:
        ways = ways.join(of.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    p = ways.select(F.col("concept_id").alias("descendant"), F.reverse("way").alias("way"))
    return p.select("descendant", F.posexplode("way").alias("distance", "ancestor")).where("distance > 0").select("descendant", "ancestor", "distance")


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(child, ancestor, distance) over any graph (child, parent), cycles too, with the least distance; a node isn't its own ancestor.

    Paths double each round: the pairs found last time, joined with all pairs, reach twice as far."""
    known = cut(edges.where("child is not null and parent is not null and child != parent").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    size = known.count()
    for _ in range(max_rounds):
        far = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("distance").alias("d2"))
        longer = known.join(far, "ancestor").where("child != a2").select("child", F.col("a2").alias("ancestor"), (F.col("distance") + F.col("d2")).alias("distance"))
        new = cut(known.unionByName(longer).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")))
        grown, same = new.count(), new.join(known, ["child", "ancestor", "distance"], "left_anti").isEmpty()
        discard(known)
        known = new
        if grown == size and same:
            break
        size = grown
    return known


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): least id reachable over links (a, b) in either direction.

    Each round takes the least label of the neighbours and then the label's own label, so labels travel twice as far each time."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = cut(label.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("new")))
        hop = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        jumped = cut(step.join(hop, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("component"), (F.least("new", F.coalesce("far", "new")) < F.col("component")).alias("moved")))
        more = not jumped.where("moved").isEmpty()
        discard(label, step)
        label = jumped.drop("moved")
        if not more:
            discard(both)
            return label


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges (child, parent, confidence) inside strongly connected components, with the component: forward and backward closure of what is left once nodes without incoming or outgoing edges are peeled off."""
    e = cut(edges.where("child is not null and parent is not null").select("child", "parent", "confidence"))
    n = e.count()
    if e.groupBy("child").count().where("count > 1").isEmpty():  # one parent each: rings are found by doubling, whatever the length of the chains
        known = e.select("child").withColumnRenamed("child", "parent").withColumn("there", F.lit(True))
        links = e.join(known, "parent", "left").select(F.col("child").alias("id"), F.when(F.col("there"), F.col("parent")).alias("parent"))
        rings, _ = hierarchy.cycles(hierarchy.climb(links)[1])
        return e.join(rings.select(F.col("id").alias("child"), F.col("root").alias("component")), "child").select("child", "parent", "confidence", "component")
    while n:
        inner = e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        inner = inner.join(e.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent", "confidence")
        new = cut(inner)
        discard(e)
        e, m = new, new.count()
        if m == n:
            break
        n = m
    loops = e.where("child = parent").withColumn("component", F.col("child"))
    if not n:
        return loops
    c = closure(e.select("child", "parent"))
    mutual = c.alias("x").join(c.alias("y"), (F.col("x.child") == F.col("y.ancestor")) & (F.col("x.ancestor") == F.col("y.child"))).select(F.col("x.child").alias("id"), F.col("x.ancestor").alias("other"))
    comp = mutual.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("component"))
    a, b = comp.select(F.col("id").alias("child"), "component"), comp.select(F.col("id").alias("parent"), F.col("component").alias("cp"))
    return e.join(a, "child").join(b, "parent").where("component = cp and child != parent").select("child", "parent", "confidence", "component").unionByName(loops.select("child", "parent", "confidence", "component"))


def remove_cycles(edges: DataFrame, default: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): per strongly connected component the edge of least confidence goes (null counts as default, ties to the least child and parent), again until none is left."""
    e = cut(edges.where("child is not null and parent is not null").select("child", "parent", F.coalesce("confidence", F.lit(default)).alias("confidence")))
    gone = None
    while True:
        inside = on_cycles(e)
        worst = cut(inside.groupBy("component").agg(F.min(F.struct("confidence", "child", "parent")).alias("w")).select("w.child", "w.parent", "w.confidence"))
        if worst.isEmpty():
            return e, gone if gone is not None else e.limit(0)
        e = cut(e.join(worst, ["child", "parent"], "left_anti"))
        gone = worst if gone is None else gone.unionByName(worst)


def attach(edges: DataFrame, more: DataFrame) -> DataFrame:
    """(child, parent, confidence) of `more` whose child has no parent in edges (child, parent): the most confident of each child, ties to the least parent; no node is its own parent."""
    free = more.where("child is not null and parent is not null and child != parent").join(edges.select("child").distinct(), "child", "left_anti")
    return free.groupBy("child").agg(F.min_by(F.struct("parent", "confidence"), F.struct(-F.coalesce("confidence", F.lit(0.0)), F.col("parent"))).alias("v")).select("child", "v.parent", "v.confidence")


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): longest way up to a node without parent; nodes on or below cycles are left out.

    Where each node has one parent the level is the depth, found by doubling.  Else it takes a round per level, as a
    longest path needs, until no node is left."""
    e = cut(edges.where("child is not null and parent is not null").select("child", "parent").distinct())
    if e.groupBy("child").count().where("count > 1").isEmpty():
        ids = e.select(F.col("child").alias("id"), "parent").unionByName(e.select(F.col("parent").alias("id")).distinct().join(e.select(F.col("child").alias("id")), "id", "left_anti").withColumn("parent", F.lit(None).cast("string")))
        return hierarchy.climb(ids)[0].select("id", F.col("depth").alias("level"))
    ids = e.select(F.col("child").alias("id")).unionByName(e.select(F.col("parent").alias("id"))).distinct()
    done = cut(ids.join(e.select(F.col("child").alias("id")), "id", "left_anti").withColumn("level", F.lit(0)))
    front, left, k = done.select("id"), e, 0
    out = done
    while True:
        k += 1
        rest = cut(left.join(front.withColumnRenamed("id", "parent"), "parent", "left_anti"))
        touched = left.join(front.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        front = cut(touched.join(rest.select(F.col("child").alias("id")), "id", "left_anti"))
        left = rest
        if front.isEmpty():
            return out
        out = out.unionByName(front.withColumn("level", F.lit(k)))
        if k % 20 == 0:  # or the plan grows with the levels
            out = cut(out)


def paths(relations: DataFrame, questions: DataFrame, max_hops: int = 4) -> DataFrame:
    """(src, dst, hops, path) of all simple paths of relations (name, domain, range) for the questions (src, dst); ways are carried only from asked sources and end at the target."""
    step = relations.select(F.col("domain").alias("at"), F.col("range").alias("to"), "name")
    cur = questions.select("src", "dst", F.col("src").alias("at"), F.array("src").alias("seen"), F.array().cast("array<string>").alias("names"))
    out = None
    for _ in range(max_hops):
        cur = cur.join(step, "at").where(~F.array_contains("seen", F.col("to"))).select("src", "dst", F.col("to").alias("at"), F.concat("seen", F.array("to")).alias("seen"), F.concat("names", F.array("name")).alias("names"))
        hit = cur.where("at = dst")
        out = hit if out is None else out.unionByName(hit)
        cur = cur.where("at != dst")
    return out.select("src", "dst", F.size("names").alias("hops"), F.array_join("names", "→").alias("path"))


def shortest_paths(relations: DataFrame, questions: DataFrame, sets: DataFrame, max_hops: int = 4) -> DataFrame:
    """(src, dst, hops, path): of the shortest ways from src to dst the one of the least names, over relations (name, domain, range) that a concept has or inherits along nested sets (hierarchy.nested_sets).

    Each question keeps one way to a concept and goes on only while its target isn't reached; a concept's relations
    are those of the owners whose ranges hold it, so no closure is made."""
    rel = relations.where("domain is not null and range is not null").select("name", "domain", "range").distinct()
    place = sets.select("concept_id", "lo", "hi")
    owned = cut(rel.join(place.withColumnRenamed("concept_id", "domain"), "domain").select("name", "range", F.col("lo").alias("qlo"), F.col("hi").alias("qhi")))
    loose = rel.join(place.select(F.col("concept_id").alias("domain")), "domain", "left_anti")  # owners outside the trees are inherited by none
    cur = cut(questions.select("src", "dst").distinct().select("src", "dst", F.col("src").alias("at"), F.lit("").alias("path")))
    seen, out = cur.select("src", "dst", "at"), None
    for k in range(1, max_hops + 1):
        near = cut(cur.select(F.col("at").alias("concept_id")).distinct().join(place, "concept_id"))
        steps = hierarchy.covering(near, owned).select(F.col("concept_id").alias("at"), "name", "range").distinct().unionByName(loose.select(F.col("domain").alias("at"), "name", "range"))
        way = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("→", "path", "name"))
        nxt = cut(cur.join(steps, "at").groupBy("src", "dst", F.col("range").alias("at")).agg(F.min(way).alias("path")).join(seen, ["src", "dst", "at"], "left_anti"))
        hit = nxt.where("at = dst").select("src", "dst", F.lit(k).alias("hops"), "path")
        out = hit if out is None else out.unionByName(hit)
        cur = nxt.join(hit.select("src", "dst"), ["src", "dst"], "left_anti")
        seen = seen.unionByName(nxt.select("src", "dst", "at"))
    return out


def multiple_parents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(child, n_parents, n_roots) of children whose parents lie under different roots; roots: id, root."""
    p = edges.select("child", "parent").distinct().join(roots.withColumnRenamed("id", "parent"), "parent")
    return p.groupBy("child").agg(F.count(F.lit(1)).alias("n_parents"), F.count_distinct("root").alias("n_roots")).where("n_parents > 1 and n_roots > 1")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
