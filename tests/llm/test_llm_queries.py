"""The registered queries on the smallest tables; those with SQL against it."""

import os

import duckdb
import pytest

from loomframe.llm import queries as llm

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, name):
    df = llm.queries()[name](spark, DIR)
    got = [r.asDict() for r in df.collect()]
    assert got or name == "op9_decontaminate"
    sql = llm.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for t in ("documents", "pages", "conversations"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        rel = c.sql(sql)
        want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
        order = sorted(df.columns)
        assert sorted(str([r[k] for k in order]) for r in got) == sorted(str([r[k] for k in order]) for r in want)
