"""Problem 6: parent-child links to full hierarchies.

Subtree sizes are computed upward, siblings (all roots among them) get preorder ranges by prefix sums downward, and the
nested-set ranges then answer everything else: the last root's range begun tells a node's root, the ranges begun and not
ended its depth, the ranges inside its own its descendants.  Both passes go by pointer doubling: after round k a node
knows the ancestor 2^k above it and what is summed up to there, so a chain of any depth takes log2(depth) rounds instead
of one per level.  Nodes that no round brings to a root are the unprocessed ones: they lie on a cycle or hang below one.

Results:
* of several versions of a node the one with the latest updated_at holds (ties: the greatest parent, nulls first);
* ids compare lower-cased and stripped; rows without an id are no nodes; a null, blank or unknown parent makes a root;
* a node that is its own parent is a cycle of one; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontoloom.functions.ids import norm_id
from ontoloom.session import cut, cut_counting, discard, once


def links(nodes: DataFrame) -> DataFrame:
    """(id, parent) of the latest version of each node; parent is null for roots."""
    v = nodes.select(norm_id("concept_id").alias("id"), norm_id("parent_id").alias("parent"), "updated_at").where("id is not null")
    last = v.groupBy("id").agg(F.max_by(F.struct("parent"), F.struct("updated_at", "parent")).alias("v")).select("id", F.col("v.parent").alias("parent"))
    known = last.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return last.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def climb(l: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parent, root, depth) of the nodes that reach a root, and (id, parent, ptr) of those that never do.

    hop is the ancestor 2^k above a node, or null once the way up has ended at `top` after `up` steps.  A round in which
    no node ends proves that none of the rest ever will: were there a node with a longer way, one on its way would have ended."""
    state, left = cut_counting(l.select("id", "parent", F.col("parent").alias("hop"), F.coalesce("parent", "id").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("up")), "hop is not null")
    while left:
        live = state.where("hop is not null")
        at = state.select(F.col("id").alias("hop"), F.col("hop").alias("h2"), F.col("top").alias("t2"), F.col("up").alias("u2"))
        moved = live.join(at, "hop").select("id", "parent", F.col("h2").alias("hop"), F.col("t2").alias("top"), (F.col("up") + F.col("u2")).alias("up"))
        old, (state, now) = state, cut_counting(moved.unionByName(state.where("hop is null")), "hop is not null")
        discard(old)
        if now == left:
            break
        left = now
    tree = state.where("hop is null").select("id", "parent", F.col("top").alias("root"), F.col("up").alias("depth"))
    return tree, state.where("hop is not null").select("id", "parent", "hop")


def cycles(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes that reach no root: (id, root) of those on cycles, root being the least id of the cycle, and (id, parent, root, depth) of those that hang below."""
    empty = rest.select("id", F.col("parent").alias("root")).limit(0)
    if rest.isEmpty():
        return empty, rest.select("id", "parent", F.col("parent").alias("root"), F.lit(0).alias("depth"))
    nxt = start = rest.select("id", F.col("parent").alias("hop"))
    size = -1
    while True:  # images under 2^k steps shrink to exactly the nodes on cycles
        image = nxt.select("hop").distinct().count()
        if image == size:
            break
        size = image
        hops = nxt.select(F.col("id").alias("hop"), F.col("hop").alias("h2"))
        old, nxt = nxt if nxt is not start else None, cut(nxt.join(hops, "hop").select("id", F.col("h2").alias("hop")))
        discard(old)
    on = cut(nxt.select(F.col("hop").alias("id")).distinct())
    ring = cut(rest.join(on, "id").select("id", F.col("parent").alias("hop"), F.col("id").alias("least")))
    while True:  # least id among the next 2^k nodes; a round without change has seen the whole cycle
        nb = ring.select(F.col("id").alias("hop"), F.col("hop").alias("h2"), F.col("least").alias("l2"))
        old, (new, more) = ring, cut_counting(ring.join(nb, "hop").select("id", F.col("h2").alias("hop"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("changed")), "changed")
        discard(old)
        ring = new.drop("changed")
        if not more:
            break
    labels = ring.select("id", F.col("least").alias("root"))
    below = rest.join(on, "id", "left_anti").select("id", "parent")
    hung = climb(below.unionByName(on.withColumn("parent", F.lit(None).cast("string"))))[0].where("depth > 0")
    hanging = hung.select("id", "parent", F.col("root").alias("entry"), "depth").join(labels.select(F.col("id").alias("entry"), "root"), "entry").select("id", "parent", "root", "depth")
    return labels, hanging


def sizes(l: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parent, size) of the nodes that reach a root, size counting the node itself, and (id, parent, hop) of the unprocessed rest.

    s holds the descendants nearer than 2^k; those of the node 2^k below come on top each round, summed by ancestor with
    a map-side combine.  As in climb(), a round in which no node ends is the last."""
    state, left = cut_counting(l.select("id", "parent", F.col("parent").alias("hop"), F.lit(1).cast("bigint").alias("s")), "hop is not null")
    while left:
        gain = state.where("hop is not null").groupBy("hop").agg(F.sum("s").alias("g")).withColumnRenamed("hop", "id")
        far = state.select(F.col("id").alias("hop"), F.col("hop").alias("h2"))
        up = state.join(gain, "id", "left").withColumn("s", F.col("s") + F.coalesce("g", F.lit(0))).drop("g")
        old, (state, now) = state, cut_counting(up.join(far, "hop", "left").select("id", "parent", F.col("h2").alias("hop"), "s"), "hop is not null")
        discard(old)
        if now == left:
            break
        left = now
    return state.where("hop is null").select("id", "parent", F.col("s").alias("size")), state.where("hop is not null").select("id", "parent", "hop")


_ROOTS = ""  # stands for the parent of all roots: no id is empty


def preorder(sized: DataFrame) -> DataFrame:
    """(id, parent, size, lo, hi): places in one preorder of all trees, from 0; a node's subtree are the nodes with lo between its lo and hi.  Siblings, and roots, go by the md5 of their ids.

    The prefix sum over siblings goes in two steps, over 256 buckets of siblings and inside them, so that a parent with
    a third of all nodes as children is no single window."""
    kids = sized.withColumn("key", F.md5(F.col("id").cast("binary"))).withColumn("up", F.coalesce("parent", F.lit(_ROOTS))).withColumn("b", F.substring("key", 1, 2))
    inner = Window.partitionBy("up", "b").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("up").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = kids.groupBy("up", "b").agg(F.sum("size").alias("w")).withColumn("base", F.coalesce(F.sum("w").over(outer), F.lit(0))).drop("w")
    before = kids.withColumn("in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, ["up", "b"]).withColumn("before", F.col("in") + F.col("base"))
    step = F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)
    cur, left = cut_counting(before.select("id", "parent", "size", F.col("parent").alias("hop"), step.alias("lo")), "hop is not null")
    while left:
        live = cur.where("hop is not null")
        far = cur.select(F.col("id").alias("hop"), F.col("hop").alias("h2"), F.col("lo").alias("l2"))
        moved = live.join(far, "hop").select("id", "parent", "size", F.col("h2").alias("hop"), (F.col("lo") + F.col("l2")).alias("lo"))
        old, (cur, left) = cur, cut_counting(moved.unionByName(cur.where("hop is null")), "hop is not null")
        discard(old)
    return cur.select("id", "parent", "size", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))


def read_ranges(placed: DataFrame, width: int = 1 << 16) -> DataFrame:
    """placed (id, parent, size, lo, hi) with root and depth: of the ranges begun at or before a place, the last of a root is its root's, and those not ended before it are its ancestors' and its own.

    A scan over the places in blocks of `width`: places are dense, so blocks are even; what ends is counted by place
    first, and what earlier blocks hold comes from a prefix over the blocks' totals."""
    block = F.floor(F.col("lo") / width)
    ends = placed.groupBy(F.col("hi").alias("lo")).agg(F.count(F.lit(1)).alias("ends"))
    first = F.when(F.col("parent").isNull(), F.struct("lo", "id"))
    p = cut(placed.join(ends, "lo", "left").select("id", "parent", "size", "lo", "hi", F.coalesce("ends", F.lit(0)).alias("ends"), first.alias("first"), block.alias("block")))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    base = p.groupBy("block").agg(F.sum("ends").alias("e"), F.max("first").alias("f")).select("block", F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("base"), F.max("f").over(earlier).alias("carry"))
    here = Window.partitionBy("block").orderBy("lo")
    seen = p.join(F.broadcast(base) if p.select("block").distinct().count() <= 1 << 16 else base, "block")
    gone = F.coalesce(F.sum("ends").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.coalesce(F.max("first").over(here.rowsBetween(Window.unboundedPreceding, 0)), F.col("carry"))
    return seen.select("id", "parent", "size", "lo", "hi", last["id"].alias("root"), (F.col("lo") - F.col("base") - gone).cast("int").alias("depth"))


def resolve(nodes: DataFrame) -> DataFrame:
    """(concept_id, parent_id, state, root_id, depth): state tree, cycle or hanging.  Trees are read from their nested-set ranges."""
    sized, rest = sizes(links(nodes))
    ring, hanging = cycles(rest)
    tree = read_ranges(preorder(sized)).select("id", "parent", "root", "depth", F.lit("tree").alias("state"))
    ringed = ring.join(rest.select("id", "parent"), "id").select("id", "parent", "root", F.lit(0).alias("depth"), F.lit("cycle").alias("state"))
    out = tree.unionByName(ringed).unionByName(hanging.withColumn("state", F.lit("hanging")))
    return out.select(F.col("id").alias("concept_id"), F.col("parent").alias("parent_id"), "state", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def nested_sets(nodes: DataFrame) -> DataFrame:
    """Nested-set table of all tree nodes: concept_id, parent_id, root_id, depth, n_descendants, lo, hi."""
    p = read_ranges(preorder(sizes(links(nodes))[0]))
    return p.select(F.col("id").alias("concept_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", (F.col("size") - 1).alias("n_descendants"), "lo", "hi")


def shared_sets(nodes: DataFrame) -> DataFrame:
    """nested_sets() of a table read from files, made once per application and state of the files."""
    return once("nested_sets", nodes, nested_sets)


def ways(nodes: DataFrame) -> DataFrame:
    """(concept_id, way): ids from the root to the node, by doubling."""
    tree = climb(links(nodes))[0]
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    cur = tree.select("id", F.col("parent").alias("hop"), F.array("id").alias("way"))
    reach = 1
    while reach <= deepest:
        far = cur.select(F.col("id").alias("hop"), F.col("hop").alias("h2"), F.col("way").alias("w2"))
        cur = cut(cur.join(far, "hop", "left").select("id", F.col("h2").alias("hop"), F.when(F.col("w2").isNull(), F.col("way")).otherwise(F.concat("w2", "way")).alias("way")))
        reach *= 2
    return cur.select(F.col("id").alias("concept_id"), "way")


def shared_ways(nodes: DataFrame) -> DataFrame:
    """ways() of a table read from files, made once per application and state of the files."""
    return once("ways", nodes, ways)


def paths(nodes: DataFrame) -> DataFrame:
    """(concept_id, path): ids from the root to the node, joined by '/'."""
    return ways(nodes).select("concept_id", F.concat_ws("/", "way").alias("path"))


def covering(points: DataFrame, ranges: DataFrame, buckets: int = 1024) -> DataFrame:
    """points (with lo) joined with the ranges (with qlo, qhi) that hold them: a range is cut at bucket borders, joined on the bucket, and filtered."""
    width = F.greatest(F.lit(1), F.ceil(F.lit(ranges.agg(F.max("qhi")).first()[0] or 0) / buckets)).cast("bigint")
    q = ranges.withColumn("b", F.explode(F.sequence(F.floor(F.col("qlo") / width), F.floor(F.col("qhi") / width))))
    return points.withColumn("b", F.floor(F.col("lo") / width)).join(q, "b").where("lo between qlo and qhi").drop("b")


def descendants_of(sets: DataFrame, ids: DataFrame | None = None, buckets: int = 1024) -> DataFrame:
    """(concept_id, descendant_id) for the ids asked for, or all, by range: a range is cut at bucket borders, joined on the bucket, and filtered."""
    asked = sets if ids is None else ids.select("concept_id").distinct().join(sets, "concept_id")
    q = asked.where("n_descendants > 0").select(F.col("concept_id").alias("q"), (F.col("lo") + 1).alias("qlo"), F.col("hi").alias("qhi"))
    d = sets.select(F.col("concept_id").alias("descendant_id"), "lo")
    return covering(d, q, buckets).select(F.col("q").alias("concept_id"), "descendant_id")


def found(nodes: DataFrame) -> DataFrame:
    return resolve(nodes).select("concept_id", "state", "root_id", "depth")
