"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from loomframe import queries as base
from loomframe.plans import session

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    return (2, f"{float(v):.6g}") if isinstance(v, (int, float)) else (3, str(v))


def rows(names, got):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(cell(r[i]) for i in at) for r in got)


@pytest.mark.parametrize("name", list(base.queries()))
def test_query(spark, duck, name):
    df = base.queries()[name](spark, DIR)
    got = rows(df.columns, df.collect())
    sql = base.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())


def test_session_settings_in_any_session(spark, monkeypatch):
    """The caller's settings, and a number of partitions that the deployment holds, leave the result as its SQL has it."""
    own, kind = spark.newSession(), type(spark.conf)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", "211")
    monkeypatch.setattr(kind, "set", lambda self, k, v, put=kind.set: None if k == "spark.sql.shuffle.partitions" else put(self, k, v))
    assert base.queries()["session_settings"](own, DIR).collect() == [("local", True, 17, True, 25)]
    assert (own.conf.get("spark.sql.adaptive.enabled"), own.conf.get("spark.sql.shuffle.partitions")) == ("false", "211")


def test_partition_shape(spark):
    own = spark.newSession()
    session.set_partition_shape(own, (9, 4))
    assert session.get_partition_shape(own) == (9, 4) and own.conf.get("spark.sql.shuffle.partitions") == "9"
    own.conf.set("spark.sql.shuffle.partitions", "12")
    assert session.get_partition_shape(own) == (12, 1)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_base_does_not_need_llm():
    here = os.path.dirname(base.__file__)
    for folder, _, files in os.walk(here):
        if f"{os.sep}llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert not re.search(r"loomframe\.llm|from \.+llm|import llm|corpus_pipeline", text), f
