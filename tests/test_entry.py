import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_entry_knows_the_subpackage():
    for f in (ROOT / "ontoloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "ontoloom").parts:
            assert not re.search(r"ontoloom\.llm|from \.llm|import llm", f.read_text()), f


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p6_paths", "hearst", "bridge_map", "crud_patterns", "fk_filter", "mentions", "chunk_auto"])
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    df = entry.queries()[name](spark, SMALL)
    want = c.sql(entry.oracle_sql()[name])
    order = [want.columns.index(x) for x in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
