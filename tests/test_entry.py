import duckdb
import pytest

import __spark_entry__ as entry

ALL = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", ALL)
def test_queries_equal_sql(spark, sf, con, name):
    a = entry.queries()[name](spark, sf).toPandas()
    b = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted(repr([None if v != v or v is None else round(v, 4) if isinstance(v, float) else str(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert key(a) == key(b)


def test_registry():
    queries = entry.queries()
    assert len(queries) > 90 and set(entry.oracle_sql()) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
