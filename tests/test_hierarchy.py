import random
from collections import defaultdict
from datetime import datetime as D

import pytest

from ontoloom.operators import hierarchy

SCHEMA = "concept_id string, parent_id string, depth int, updated_at timestamp_ntz, state string"


def frame(spark, links):
    return spark.createDataFrame([(c, p, 7, D(2024, 1, 1), "x") for c, p in links], SCHEMA)


def brute(links):
    par = dict(links)
    par = {c: p if p in par else None for c, p in par.items()}
    out = set()
    for c in par:
        seen, x = [], c
        while x is not None and x not in seen:
            seen.append(x)
            x = par[x]
        if x is None:
            out.add((c, "tree", seen[-1], len(seen) - 1))
        else:
            ring = seen[seen.index(x) :]
            out.add((c, "cycle" if c in ring else "hanging", min(ring), seen.index(x)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    n = 60
    links = [(f"n{i}", f"n{r.randrange(i)}" if i and r.random() < 0.8 else r.choice([None, " ", "gone", f"n{r.randrange(n)}"])) for i in range(n)]
    assert {tuple(x) for x in hierarchy.found(frame(spark, links)).collect()} == brute([(c, p) for c, p in links])


def test_long_chain_hub_and_ranges(spark):
    links = [("c0", None)] + [(f"c{i}", f"c{i - 1}") for i in range(1, 40)] + [(f"k{i}", "c3") for i in range(30)]
    df = frame(spark, links)
    assert {tuple(x) for x in hierarchy.found(df).collect()} == brute(links)
    sets = hierarchy.nested_sets(df).collect()
    at = {x.concept_id: x for x in sets}
    assert sorted(x.lo for x in sets) == list(range(len(links)))
    below = defaultdict(set)
    par = dict(links)
    for c in par:
        x = par[c]
        while x:
            below[x].add(c)
            x = par[x]
    for c, x in at.items():
        assert {k for k, y in at.items() if x.lo < y.lo <= x.hi} == below[c] and x.n_descendants == len(below[c])
    path = {x.concept_id: x.path for x in hierarchy.paths(df).collect()}
    assert path["c4"] == "c0/c1/c2/c3/c4" and path["k7"] == "c0/c1/c2/c3/k7"
    got = hierarchy.descendants_of(hierarchy.nested_sets(df), spark.createDataFrame([("c3",)], "concept_id string"), buckets=8)
    assert {r.descendant_id for r in got.collect()} == below["c3"]


def test_versions_and_spelling(spark):
    df = spark.createDataFrame([("A ", None, 0, D(2024, 1, 1), ""), ("b", "a", 0, D(2024, 1, 1), ""), ("B", None, 0, D(2024, 1, 2), ""), ("B", None, 0, D(2024, 1, 2), ""), (None, "a", 0, None, ""), ("s", "S", 0, D(2024, 1, 1), "")], SCHEMA)
    assert {tuple(r) for r in hierarchy.found(df).collect()} == {("a", "tree", "a", 0), ("b", "tree", "b", 0), ("s", "cycle", "s", 0)}


def test_empty(spark):
    df = frame(spark, [("a", None)]).limit(0)
    assert hierarchy.found(df).count() == 0 and hierarchy.nested_sets(df).count() == 0 and hierarchy.paths(df).count() == 0
