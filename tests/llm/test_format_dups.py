import random

import pytest

from ontoloom.llm import format_dups as fd
from ontoloom.llm.sql_canon import canonical

SAME = [
    ("SELECT a, b FROM t WHERE x = 1", ["select b ,a from t where (x=1);", "SELECT `B`, [a]\nFROM \"t\" WHERE x　=　1 ；", "select a，b from t where ((x = 1)) ;;", "Select a,b From t -- note\nWhere x=1"]),
    ("UPDATE t SET a = ?, b = 'x' WHERE c > 2 AND d IS NULL", ["update T set B='X',A=? where (c>2) and (d is null)", 'update t set b = "x", a = ? where c > 2 and d is null']),
    ("INSERT INTO t (a, b) VALUES (1, 2)", ["insert into `t`(b,a) values(2,1)"]),
    ("DELETE FROM t WHERE a = ? AND (b = 1 OR c = 2)", ["delete from t where (a = ?) and ((b = 1) or (c = 2))"]),
    ("SELECT SUM(a) AS s, COUNT(*) AS n FROM t GROUP BY b, c", ["select count( * ) as n , sum(a) as s from t group by b,c"]),
]
DIFFERENT = [
    "select a, b from t where x = 1", "select a, b from t where x = 2", "select a, b from t where x <> 1", "select a, b from t where x = '1'", "select a from t where x = 1", "select a, b from u where x = 1",
    "select a, b from t where x = 1 and y = 2", "select a, b from t where y = 2 and x = 1", "select a, b from t where x = 1 or y = 2", "select a, b from t where x = 1 limit 1", "select a, b from t where x = 1 order by a", "select a, b from t where x = 1 order by a desc",
    "select a, b from t where x = 1 order by a, b", "select a, b from t where x = 1 order by b, a", "select a, b from t where (x = 1 or y = 2) and z = 3", "select a, b from t where x = 1 or (y = 2 and z = 3)", "select a, b from t where x = a", "select a, b from t where x = 'a'",
    "insert into t (a, b) values (1, 2)", "insert into t (a, b) values (2, 1)", "select a, b from t group by a, b", "select a, b from t group by b, a", "select t.a, b from t where x = 1", "select a, b from t where x between 1 and 2", "select a, b from t where not (x = 1 and y = 2)", "select a, b from t where not x = 1 and y = 2",
]


@pytest.mark.parametrize("text, others", SAME)
def test_same(text, others):
    assert {canonical(x) for x in others} == {canonical(text)}


def test_different():
    assert len({canonical(x) for x in DIFFERENT}) == len(DIFFERENT)


def test_nothing():
    assert canonical(None) is None and canonical(" ;；\n") is None and canonical("(((") is not None and canonical("select") == "select"


def test_long():
    assert canonical("select " + ", ".join(f"c{i}" for i in range(3000)) + " from t") == canonical("select " + ", ".join(f"c{i}" for i in reversed(range(3000))) + " from t;")


def log(spark, n=400):
    r = random.Random(1)
    texts = [s for t, o in SAME for s in (t, *o)] + DIFFERENT + [None, "", " ; "]
    rows = [(i, "select a from hot where x = 1" + ";" * (i % 3) if i % 3 == 0 else r.choice(texts), r.choice([1, 2, None])) for i in range(n)]
    return rows, spark.createDataFrame([(*x, "clash") for x in rows], "log_id bigint, sql string, frequency bigint, canon string")


@pytest.mark.parametrize("bucket_rows", [1, 7, 50_000])
def test_against_brute_force(spark, bucket_rows):
    rows, df = log(spark)
    first, want, count, freq = {}, set(), {}, {}
    for i, s, f in rows:
        c = canonical(s)
        if c is None:
            continue
        if c in first:
            want.add((first[c], i))
        first.setdefault(c, i)
        count[c] = count.get(c, 0) + 1
        freq[c] = freq.get(c, 0) + (f or 0)
    assert {tuple(r) for r in fd.found(df, bucket_rows).collect()} == want
    got = fd.collapse(df, bucket_rows).collect()
    assert {(r.first_log_id, r.canonical_sql, r.n_copies, r.sum_frequency) for r in got} == {(first[c], c, count[c], freq[c]) for c in first} and len(got) == len(first)


def test_empty(spark):
    _, df = log(spark, 3)
    assert fd.found(df.limit(0)).count() == 0 and fd.collapse(df.limit(0)).count() == 0


def test_trie():
    t = fd.Trie()
    for k in (b"", b"a" * 16, b"a" * 17, b"a" * 16):
        t.add(k, 1, 2, 3)
    assert dict(t.items()) == {b"": [1, 2, 3], b"a" * 16: [2, 4, 3], b"a" * 17: [1, 2, 3]}
