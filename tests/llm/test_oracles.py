"""Queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from cuemill.llm import queries
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == want


def test_quality_rules_with_cutoffs_on(spark):
    """With enough labels cutoffs are safe, and reject documents that the base rule keeps."""
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.queries()["op10_quality_rules"](spark, folder)
    want = con.execute(f"SELECT doc_id, n_words, n_repeat_words, base_failed, kept FROM ({queries.oracle_sql()['op10_quality_rules']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept").collect())
    assert sum(not failed and not kept for *_, failed, kept in want) > 100
