"""The registered queries of the entity graph run, with the columns that their SQL counterparts have."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from nodeloom.plans import catalog_queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = [tuple(dict(zip(columns, r, strict=True))[c] for c in names) for r in found.fetchall()]
    assert sorted(columns) == names
    assert plain([tuple(r[c] for c in names) for r in df.collect()]) == plain(want)


def test_flagship(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    df = entry.entry(spark)
    assert df.columns == ["region", "nation", "customer", "supplier", "orders"] and df.count() == 1500
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_scans_read_key_columns_only(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_name" not in plan
