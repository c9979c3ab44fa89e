"""Every registered query with SQL agrees with DuckDB at the smallest scale."""

import duckdb
import pytest

from lectern.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{D}/{n}.parquet'")
    return c


def rows(df, cols):
    return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, con, name):
    ours, theirs = catalog.QUERIES[name](spark, D).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    assert rows(ours, cols) == rows(theirs, cols)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert {r.kind for r in __spark_entry__.entry(spark).collect()} <= {"empty", "fragment", "external", "path"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
