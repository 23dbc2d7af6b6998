"""Every query with SQL against DuckDB over the smallest tables; the rest must run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(plain(r[i])) for i in order) for r in rows)), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


CORE = {k: v for k, v in entry.queries().items() if not getattr(v, "__module__", "").startswith("menuflow.llm")}


@pytest.mark.parametrize("name", sorted(k for k in CORE if k in entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = CORE[name](spark, FOLDER)
    mine, names = as_rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(entry.oracle_sql()[name]).df()
    theirs, other = as_rows(list(found.columns), [tuple(None if x != x else x for x in r) for r in found.astype(object).where(found.notna(), None).values.tolist()])
    assert names == other
    assert [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in mine] == [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in theirs]


@pytest.mark.parametrize("name", sorted(k for k in CORE if k not in entry.oracle_sql()))
def test_runs(spark, name):
    assert CORE[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
