"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from lexloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(want.columns)
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert order(mine).equals(order(want))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "score", "rank"]
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
