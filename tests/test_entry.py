"""The driver's contract: every query runs, and equals its SQL, on small tables."""

import os
import subprocess
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry
from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(value, 6) if isinstance(value, float) else str(value) if value is not None else None


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    cur = con.execute(catalog.SQL[name])
    cols = [c[0] for c in cur.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_a_session():
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=os.path.dirname(entry.__file__), timeout=120).returncode == 0


def test_the_rest_does_not_import_the_optional_part():
    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(os.path.join(root, "tidemark")):
        if "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
