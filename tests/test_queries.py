"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import math

import duckdb
import pytest

from cuemill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name in catalog.oracle_sql():
        cursor = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
        assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == want
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
