from datetime import datetime as D

from ontoloom.functions import bloom
from ontoloom.operators import orphans
from pyspark.sql import functions as F


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    words = bloom.build(keys, "k", max_bits=1 << 14)  # far too small: many false positives, still no false negative
    assert keys.where(~bloom.might_contain(keys, words, F.col("k"))).count() == 0
    big = bloom.build(keys, "k")
    other = spark.range(10000, 20000).select(F.col("id").cast("string").alias("k"))
    assert other.where(bloom.might_contain(other, big, F.col("k"))).count() < 200


def tables(spark):
    con = spark.createDataFrame([(" Concept_A ", D(2023, 1, 2)), ("concept_a", D(2023, 1, 1)), ("concept_b", D(2023, 6, 1)), ("concept_c", D(2023, 1, 1)), (None, D(2023, 1, 1))], "id string, loaded_at timestamp_ntz")
    prop = spark.createDataFrame([("p1", "concept_A", D(2023, 2, 1), D(2023, 2, 2)), ("p1", "concept_A", D(2023, 2, 1), D(2023, 3, 2)), ("p2", "concept_b　", D(2023, 2, 1), D(2023, 2, 2)), ("p3", "concept_x", None, D(2023, 2, 2)), ("p4", " ", D(2023, 2, 1), D(2023, 2, 2)), ("p5", None, D(2023, 2, 1), None), ("p6", "concept_c", D(2023, 2, 1), None)], "id string, domain_concept_id string, created_at timestamp_ntz, loaded_at timestamp_ntz")
    rel = spark.createDataFrame([("r1", "concept_c", "concept_y", D(2024, 2, 1), D(2024, 2, 2), "clash")], "id string, domain_concept_id string, range_concept_id string, created_at timestamp_ntz, loaded_at timestamp_ntz, key string")
    chg = spark.createDataFrame([(1, "create", "concept", "concept_c", D(2023, 1, 1)), (2, " DELETE", "Concept", "CONCEPT_C", D(2023, 5, 1)), (3, "delete", "relation", "concept_a", D(2023, 5, 1))], "change_id bigint, op string, target string, ref string, changed_at timestamp_ntz")
    return {"onto_property": prop, "onto_relation": rel}, con, chg


def test_reasons(spark):
    got = sorted(tuple(r) for r in orphans.orphans(*tables(spark)).collect())
    assert got == [("onto_property", "p2", "domain_concept_id", "2023-02", "late"), ("onto_property", "p3", "domain_concept_id", None, "missing"), ("onto_property", "p6", "domain_concept_id", "2023-02", "deleted"), ("onto_relation", "r1", "domain_concept_id", "2024-02", "deleted"), ("onto_relation", "r1", "range_concept_id", "2024-02", "missing")]


def test_small_filter_gives_the_same_rows(spark):
    t = tables(spark)
    assert sorted(map(tuple, orphans.orphans(*t, max_bits=4096).collect())) == sorted(map(tuple, orphans.orphans(*t).collect()))


def test_empty_tables(spark):
    t, con, chg = tables(spark)
    none = {k: v.limit(0) for k, v in t.items()}
    assert orphans.orphans(none, con.limit(0), chg.limit(0)).count() == 0
    assert {r.reason for r in orphans.orphans(t, con.limit(0), chg).collect()} == {"missing"}
