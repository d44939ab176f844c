"""Registered queries that call the library's methods one by one, and their SQL.

Methods whose results are values of the driver (statistics, lists, sizes) are shown as small frames of them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.datetimes import date_range, to_datetime
from .operators.frame import Frame, concat
from .operators.groupby import Grouper
from .plans import session
from .plans.store import scratch
from .sources import from_dict, from_numpy, from_pandas, read_csv, read_feather, read_parquet, series
from .sources.channel import DataReceiver, DataSender
from .streaming import csv_sink, csv_source, reduce_by_key

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _table(spark, sf_dir, name) -> Frame:
    from .queries import table

    return table(spark, sf_dir, name)


def _keyed(spark, sf_dir, name, key) -> Frame:
    return _table(spark, sf_dir, name).set_index(key, drop=False)


def _path(spark, name) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


# -- statistics
_STATS = {"sum": "sum({0})", "min": "min({0})", "max": "max({0})", "mean": "avg({0})", "median": "median({0})", "count": "count({0})", "std": "stddev_samp({0})", "var": "var_samp({0})", "sem": "stddev_samp({0})/sqrt(count({0}))", "nunique": "count(DISTINCT {0})", "skew": "skewness({0})"}
_union_sql = lambda parts: " UNION ALL ".join(parts)


@query(_union_sql(f"SELECT '{n}' AS stat, round(({e.format('p_size')})::DOUBLE, 4) AS p_size, round(({e.format('p_retailprice')})::DOUBLE, 4) AS p_retailprice FROM part" for n, e in _STATS.items()))
def stats_methods(spark, sf_dir):
    f = _table(spark, sf_dir, "part")[["p_size", "p_retailprice"]]
    rows = [(n, *(round(float(getattr(f, n)()[c]), 4) for c in f.columns)) for n in _STATS]
    return spark.createDataFrame(rows, "stat string, p_size double, p_retailprice double")


@query(_union_sql(f"SELECT '{n}' AS stat, round(({e.format('c_acctbal')})::DOUBLE, 4) AS v FROM customer" for n, e in _STATS.items()))
def series_stats(spark, sf_dir):
    s = _table(spark, sf_dir, "customer")["c_acctbal"]
    return spark.createDataFrame([(n, round(float(getattr(s, n)()), 4)) for n in _STATS], "stat string, v double")


@query("SELECT n_regionkey, min(n_nationkey) AS lo, max(n_nationkey) AS hi, sum(n_nationkey)::BIGINT AS s, count(n_nationkey) AS n, bool_or(n_nationkey > 20) AS a, bool_and(n_nationkey < 20) AS e FROM nation GROUP BY 1")
def stats_by_level(spark, sf_dir):
    f = _table(spark, sf_dir, "nation").set_index("n_regionkey")
    f = f.assign(a=f["n_nationkey"] > 20, e=f["n_nationkey"] < 20)
    k = f[["n_nationkey"]]
    out = [getattr(k, how)(level=0).to_spark(index=True).withColumnRenamed("n_nationkey", new) for how, new in (("min", "lo"), ("max", "hi"), ("sum", "s"), ("count", "n"))]
    out += [f[["a"]].any(level="n_regionkey").to_spark(index=True), f[["e"]].all(level="n_regionkey").to_spark(index=True)]
    one = out[0]
    for o in out[1:]:
        one = one.join(o, "n_regionkey")
    return one


@query("SELECT l_orderkey, l_linenumber, (l_quantity + l_tax) / 2 AS mean, l_quantity * l_tax AS prod, least(l_quantity, l_tax) AS lo, 2 AS n FROM lineitem")
def stats_across(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    two = li[["l_quantity", "l_tax"]]
    out = li.assign(mean=two.mean(axis=1), prod=two.prod(axis=1), lo=two.min(axis=1), n=two.count(axis=1))
    return out[["l_orderkey", "l_linenumber", "mean", "prod", "lo", "n"]].to_spark()


# -- group-by functions one by one
_GROUPED = {"sum": "sum(v)", "count": "count(v)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "median": "median(v)", "std": "stddev_samp(v)", "var": "var_samp(v)", "sem": "stddev_samp(v)/sqrt(count(v))", "skew": "skewness(v)", "nunique": "count(DISTINCT v)", "first": "arg_min(v, k)", "last": "arg_max(v, k)"}


@query("WITH t AS (SELECT p_brand AS g, p_retailprice AS v, p_partkey AS k FROM part) " + _union_sql(f"SELECT '{n}' AS how, g AS p_brand, round(({e})::DOUBLE, 3) AS v FROM t GROUP BY g" for n, e in _GROUPED.items()))
def gb_methods(spark, sf_dir):
    g = _table(spark, sf_dir, "part").groupby("p_brand", as_index=False)[["p_retailprice"]]
    return _union(getattr(g, n)().to_spark().select(F.lit(n).alias("how"), "p_brand", F.round(F.col("p_retailprice").cast("double"), 3).alias("v")) for n in _GROUPED)


@query("SELECT n_regionkey, product(n_nationkey + 1) AS p, bool_and(n_nationkey > 2) AS every, bool_or(n_nationkey > 20) AS some FROM nation GROUP BY 1")
def gb_prod_all_any(spark, sf_dir):
    f = _table(spark, sf_dir, "nation")
    f = f.assign(p=f["n_nationkey"] + 1, every=f["n_nationkey"] > 2, some=f["n_nationkey"] > 20)
    g = f.groupby("n_regionkey", as_index=False)
    return g[["p"]].prod().to_spark().join(g[["every"]].all().to_spark(), "n_regionkey").join(g[["some"]].any().to_spark(), "n_regionkey")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS imin FROM orders GROUP BY 1")
def gb_idxmin(spark, sf_dir):
    return _keyed(spark, sf_dir, "orders", "o_orderkey").groupby("o_custkey", as_index=False)[["o_totalprice"]].idxmin().rename(columns={"o_totalprice": "imin"}).to_spark()


@query("SELECT o_orderstatus, round(corr(o_totalprice, o_totalprice + o_custkey), 6) AS r FROM orders GROUP BY 1")
def gb_corrwith(spark, sf_dir):
    orders = _keyed(spark, sf_dir, "orders", "o_orderkey")
    other = orders.assign(o_totalprice=orders["o_totalprice"] + orders["o_custkey"])[["o_totalprice"]]
    got = orders[["o_orderstatus", "o_totalprice"]].groupby("o_orderstatus", as_index=False).corrwith(other)
    return got.to_spark().select("o_orderstatus", F.round("o_totalprice", 6).alias("r"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IN (1, 3)")
def gb_take(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupby("o_custkey").take([0, 2])[["o_custkey", "o_orderkey"]].to_spark()


@query("SELECT event_id, sum(user_id % 7) OVER w AS s, min(value) OVER w AS lo, product(1 + user_id % 2) OVER w > 1 AS p FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def gb_cumulative(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    e = e.assign(g=e["user_id"] % 20, a=e["user_id"] % 7, b=e["user_id"] % 2 + 1)
    g = e.groupby("g")
    s = g[["a"]].cumsum().sdf.select("event_id", F.col("a").alias("s"))
    lo = g[["value"]].cummin().sdf.select("event_id", F.col("value").alias("lo"))
    return s.join(lo, "event_id").join(g[["b"]].cumprod().sdf.select("event_id", (F.col("b") > 1).alias("p")), "event_id")


@query("SELECT event_id, ts + INTERVAL 2 DAY AS ts FROM events")
def gb_tshift(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupby("user_id").tshift(2, "D", on="ts")[["event_id", "ts"]].to_spark()


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN value END, -1) AS value FROM events")
def gb_fillna(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.assign(value=e["value"].where(e["event_id"] % 3 > 0)).groupby("user_id")[["value"]].fillna(-1.0).sdf.select("event_id", "value")


@query("SELECT o_orderstatus, max(o_totalprice) AS m FROM orders GROUP BY 1")
def series_groupby(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return orders["o_totalprice"].groupby(orders["o_orderstatus"]).max().reset_index().rename(columns={"o_totalprice": "m"}).to_spark()


@query("SELECT c_mktsegment, round(median(c_acctbal), 6) AS q5, round(quantile_cont(c_acctbal, 0.9), 6) AS q9 FROM customer GROUP BY 1")
def gb_median_quantile(spark, sf_dir):
    g = _table(spark, sf_dir, "customer").groupby("c_mktsegment", as_index=False)[["c_acctbal"]]
    q9 = g.quantile(0.9).to_spark().select("c_mktsegment", F.round("c_acctbal", 6).alias("q9"))
    return g.median().to_spark().select("c_mktsegment", F.round("c_acctbal", 6).alias("q5")).join(q9, "c_mktsegment")


@query("SELECT event_id, rank() OVER a AS mn, dense_rank() OVER d AS ds, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS f FROM events WINDOW a AS (PARTITION BY event_type ORDER BY user_id), d AS (PARTITION BY event_type ORDER BY user_id DESC)")
def gb_rank_methods(spark, sf_dir):
    g = _table(spark, sf_dir, "events").groupby("event_type")[["user_id"]]
    got = [g.rank(**k).sdf.select("event_id", F.col("user_id").alias(n)) for n, k in (("mn", {"method": "min"}), ("ds", {"method": "dense", "ascending": False}), ("f", {"method": "first"}))]
    return got[0].join(got[1], "event_id").join(got[2], "event_id")


@query("SELECT event_id, lead(value, 2) OVER w AS s, value - lag(value, 3) OVER w AS d, count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def gb_shift_back(spark, sf_dir):
    g = _table(spark, sf_dir, "events").groupby("event_type")
    s, d = g[["value"]].shift(-2).sdf.select("event_id", F.col("value").alias("s")), g[["value"]].diff(3).sdf.select("event_id", F.col("value").alias("d"))
    return s.join(d, "event_id").join(g.cumcount(ascending=False).frame.sdf.select("event_id", F.col("cumcount").alias("c")), "event_id")


@query("SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN value END AS v FROM events)")
def gb_ffill_limit(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.assign(v=e["value"].where(e["event_id"] % 5 == 0)).groupby("event_type")[["v"]].ffill(limit=2).sdf.select("event_id", "v")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING max(n_nationkey) > 21)")
def gb_filter_function(spark, sf_dir):
    return _table(spark, sf_dir, "nation").groupby("n_regionkey").filter(lambda g: g["n_nationkey"].max() > 21 and len(g) > 1)[["n_nationkey"]].to_spark()


@query("SELECT n_nationkey % 3 AS key, count(*) AS size FROM nation GROUP BY 1")
def gb_callable(spark, sf_dir):
    return _keyed(spark, sf_dir, "nation", "n_nationkey").groupby(lambda k: k % 3, as_index=False).size().to_spark()


@query("SELECT n_nationkey, n_nationkey - min(n_nationkey) OVER (PARTITION BY n_regionkey)::DOUBLE AS d FROM nation")
def gb_transform_function(spark, sf_dir):
    f = _keyed(spark, sf_dir, "nation", "n_nationkey")
    f = f.assign(d=f["n_nationkey"] + 0)
    return f.groupby("n_regionkey")[["d"]].transform(lambda s: s - s.min()).sdf.select("n_nationkey", "d")


@query("SELECT n_regionkey, min(n_nationkey) AS lo FROM nation GROUP BY 1")
def gb_apply_inferred(spark, sf_dir):
    return _table(spark, sf_dir, "nation").groupby("n_regionkey").apply(lambda g: g.nsmallest(1, "n_nationkey")[["n_regionkey", "n_nationkey"]].rename(columns={"n_nationkey": "lo"}))


@query("SELECT n_regionkey AS key, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS labels, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS places, count(*) AS n, (SELECT count(DISTINCT n_regionkey) FROM nation) AS groups FROM nation GROUP BY 1")
def gb_groups(spark, sf_dir):
    g = _keyed(spark, sf_dir, "nation", "n_nationkey").groupby("n_regionkey")
    text = lambda d: {k: ",".join(map(str, v)) for k, v in d.items()}
    labels, places, size = text(g.groups), text(g.indices), {k: len(f) for k, f in g}
    return spark.createDataFrame([(k, labels[k], places[k], size[k], len(g)) for k in labels], "key int, labels string, places string, n long, groups long")


@query("SELECT date_trunc('day', ts) AS ts, count(*) AS size FROM events GROUP BY 1")
def gb_grouper(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupby(Grouper("ts", "D"), as_index=False).size().to_spark()


# -- frames: windows, order, sets
@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 9")
def head_rows(spark, sf_dir):
    return _table(spark, sf_dir, "orders").head(9)[["o_orderkey"]].to_spark()


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS at FROM part")
def sort_values_labels(spark, sf_dir):
    f = _keyed(spark, sf_dir, "part", "p_partkey").sort_values("p_retailprice", ascending=False)
    return f.sdf.select("p_partkey", F.col("__sorted").alias("at"))


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 4")
def sort_index_down(spark, sf_dir):
    return _keyed(spark, sf_dir, "nation", "n_nationkey").sort_index(ascending=False).head(4)[["n_nationkey"]].to_spark()


@query("SELECT n_nationkey AS k, n_nationkey + n_regionkey AS b, n_nationkey AS a FROM nation")
def cum_axis1(spark, sf_dir):
    f = _keyed(spark, sf_dir, "nation", "n_nationkey")
    f = Frame(f.sdf.select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b")), ["a", "b"], ["k"], ["k"])
    return f.cumsum(axis=1).to_spark(index=True)


@query("SELECT event_id, CASE WHEN event_id < (SELECT min(event_id) FROM events WHERE event_id > 50) THEN sum(user_id) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT END AS v FROM events")
def cum_skipna(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.assign(v=e["user_id"].where(e["event_id"] <= 50))[["v"]].cumsum(skipna=False).sdf.select("event_id", "v")


@query("SELECT p_partkey, product(CASE WHEN p_size = 1 THEN 2.0 ELSE 1 END) OVER w AS p, max(p_size) OVER w AS hi, min(p_size) OVER w AS lo FROM part WINDOW w AS (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)")
def cum_methods(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    p = p.assign(p=p["p_size"].where(p["p_size"] == 1, 0) + 1, hi=p["p_size"], lo=p["p_size"])
    out = p[["p"]].cumprod().sdf.select("p_partkey", "p")
    return out.join(p[["hi"]].cummax().sdf.select("p_partkey", "hi"), "p_partkey").join(p[["lo"]].cummin().sdf.select("p_partkey", "lo"), "p_partkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < n_regionkey THEN 1.0 WHEN n_nationkey = n_regionkey THEN 1.5 ELSE 2 END::DOUBLE AS a, CASE WHEN n_nationkey < n_regionkey THEN 2.0 WHEN n_nationkey = n_regionkey THEN 1.5 ELSE 1 END::DOUBLE AS b FROM nation")
def rank_axis1(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    f = n.assign(a=n["n_nationkey"] + 0, b=n["n_regionkey"] + 0)[["a", "b"]].rank(axis=1)
    return f.sdf.select("n_nationkey", "a", "b")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def append_frames(spark, sf_dir):
    a = _table(spark, sf_dir, "nation")[["n_nationkey", "n_name"]].rename(columns={"n_nationkey": "k", "n_name": "name"})
    return a.append(_table(spark, sf_dir, "region")[["r_regionkey", "r_name"]].rename(columns={"r_regionkey": "k", "r_name": "name"}), ignore_index=True).to_spark()


@query("SELECT i AS at, v::DOUBLE AS v FROM (VALUES (0, 11.0), (1, 22.0), (2, 33.0), (3, NULL)) t(i, v)")
def aligned_order(spark, sf_dir):
    """Sums of frames labelled c, a, b and b, c, a, z, in the order of the first."""
    a, b = from_dict(spark, {"v": [1, 2, 3]}, index=["c", "a", "b"]), from_dict(spark, {"v": [30, 10, 20, 5]}, index=["b", "c", "a", "z"])
    return spark.createDataFrame([(i, None if pd.isna(v) else float(v)) for i, v in enumerate(a.add(b)["v"].to_list())], "at long, v double")


@query("SELECT i AS at, k, v, w FROM (VALUES (0, 'c', 1, 10), (1, 'a', 2, 20), (2, 'b', 3, 30)) t(i, k, v, w)")
def concat_order(spark, sf_dir):
    a, b = from_dict(spark, {"v": [1, 2, 3]}, index=["c", "a", "b"]), from_dict(spark, {"w": [30, 10, 20]}, index=["b", "c", "a"])
    return spark.createDataFrame([(i, k, int(r["v"]), int(r["w"])) for i, (k, r) in enumerate(concat([a, b], axis=1).iterrows())], "at int, k string, v int, w int")


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN 0.5 * lag(value, 2) OVER o + lag(value) OVER o + 0.5 * value END AS t FROM events WINDOW o AS (ORDER BY ts, event_id), w AS (ORDER BY ts, event_id ROWS 2 PRECEDING)")
def rolling_weighted(spark, sf_dir):
    m = _table(spark, sf_dir, "events")["value"].rolling(3, win_type="triang", on="ts").sum()
    return m.frame.sdf.select("event_id", F.col("__v").alias("t"))


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) IN (3, 6, 9)")
def iloc_step(spark, sf_dir):
    return _table(spark, sf_dir, "orders").iloc[2:10:3][["o_orderkey"]].to_spark()


# -- setting
@query("SELECT p_partkey, p_size * 2 AS p_size, p_size + 1 AS twice, 7 AS seven, upper(p_brand) AS p_brand FROM part")
def setitem_columns(spark, sf_dir):
    f = _table(spark, sf_dir, "part")
    size = f["p_size"]
    f["twice"] = size + 1
    f["seven"] = 7
    f[["p_size", "p_brand"]] = [size * 2, f["p_brand"].apply(F.upper)]
    return f[["p_partkey", "p_size", "twice", "seven", "p_brand"]].to_spark()


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey > 20 THEN 0 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_regionkey > 20 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
def setitem_mask(spark, sf_dir):
    f = Frame(_table(spark, sf_dir, "nation").sdf.withColumn("id", F.col("n_nationkey")), ["n_nationkey", "n_regionkey"], ["id"], ["id"])
    f[f > 20] = 0
    return f.to_spark(index=True)


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'first' WHEN n_nationkey = 7 THEN 'seven' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 7 THEN 70 ELSE n_regionkey END AS n_regionkey FROM nation")
def loc_iloc_set(spark, sf_dir):
    f = _keyed(spark, sf_dir, "nation", "n_nationkey")
    f.iloc[0:3, 1] = "first"
    f.loc[7, ["n_name", "n_regionkey"]] = ["seven", 70]
    return f[["n_nationkey", "n_name", "n_regionkey"]].to_spark()


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (3, 5) THEN -1 WHEN n_regionkey = 4 THEN 40 ELSE n_regionkey END AS v FROM nation")
def series_setitem(spark, sf_dir):
    s = _keyed(spark, sf_dir, "nation", "n_nationkey")["n_regionkey"]
    s[s == 4] = 40
    s[[3, 5]] = -1
    return spark.createDataFrame([(k, int(v)) for k, v in s.items()], "k int, v int")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey > 3 THEN n_nationkey ELSE -n_nationkey END AS n_nationkey, CASE WHEN n_regionkey > 3 THEN n_regionkey ELSE -n_regionkey END AS n_regionkey, CASE WHEN r_regionkey IS NOT NULL THEN NULL ELSE n_nationkey END AS m FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def where_mask_frames(spark, sf_dir):
    f = Frame(_table(spark, sf_dir, "nation").sdf.withColumn("id", F.col("n_nationkey")), ["n_nationkey", "n_regionkey"], ["id"], ["id"])
    w = f.where(lambda x: x > 3, lambda x: x * -1)
    region = _table(spark, sf_dir, "region").sdf
    known = Frame(region.select(F.col("r_regionkey").alias("id"), F.lit(True).alias("n_nationkey")), ["n_nationkey"], ["id"], ["id"])
    m = f[["n_nationkey"]].mask(known, None)
    return w.to_spark(index=True).join(m.to_spark(index=True).withColumnRenamed("n_nationkey", "m"), "id")


@query("SELECT n_nationkey, 'x' AS tag, n_regionkey, n_name FROM nation")
def insert_column(spark, sf_dir):
    return _table(spark, sf_dir, "nation").insert(1, "tag", "x").to_spark().select("n_nationkey", "tag", "n_regionkey", "n_name")


@query("SELECT chr(97 + r_regionkey) AS label, r_name FROM region WHERE r_regionkey <> 1")
def set_axis_drop_rows(spark, sf_dir):
    f = _table(spark, sf_dir, "region")[["r_name"]].set_axis(list("abcde")).drop(index=["b"])
    return f.to_spark(index=True).toDF("label", "r_name")


@query("SELECT r_regionkey AS a, r_name AS b FROM region WHERE r_regionkey <> 2")
def droplevel_drop_level(spark, sf_dir):
    f = _table(spark, sf_dir, "region").assign(v=1).set_index(["r_regionkey", "r_name"])
    return f.drop(index=[2], level="r_regionkey").reset_index()[["r_regionkey", "r_name"]].set_index(["r_regionkey", "r_name"]).droplevel("r_name").reset_index().merge(_table(spark, sf_dir, "region"), on="r_regionkey")[["r_regionkey", "r_name"]].to_spark().toDF("a", "b")


@query("SELECT (SELECT count(*) FROM nation) AS rows, 3 AS cols, (SELECT count(*) * 3 FROM nation) AS size, false AS empty, 'int' AS kind, true AS same, (SELECT min(r_name) FROM region WHERE r_regionkey = 0) AS item, (SELECT sum(n_nationkey)::BIGINT FROM nation) AS total")
def frame_attributes(spark, sf_dir):
    f, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    item = r[r["r_regionkey"] == 0]["r_name"]
    total = int(f["n_nationkey"].to_numpy().sum()) if sum(1 for _ in f) == 3 else -1
    row = (f.shape[0], f.shape[1], f.size, f.empty, f.dtypes["n_nationkey"], f.equals(f.copy()) and item.squeeze() == item.item(), item.item(), total)
    return spark.createDataFrame([row], "rows long, cols int, size long, empty boolean, kind string, same boolean, item string, total long")


@query("SELECT n_nationkey AS k, n_name AS a, n_name AS b, n_name AS c, n_regionkey + 0 AS d FROM nation")
def row_iteration(spark, sf_dir):
    f = _keyed(spark, sf_dir, "nation", "n_nationkey")
    rows, names, of = dict(f.iterrows()), dict(f["n_name"].items()), f["n_name"].to_dict()
    values = f[["n_regionkey"]].to_numpy()[:, 0].tolist()
    return spark.createDataFrame([(k, r["n_name"], names[k], of[k], v) for (k, r), v in zip(rows.items(), values, strict=True)], "k int, a string, b string, c string, d int")


@query("SELECT n_nationkey AS id, n_nationkey < 5 AS lt, n_nationkey >= 5 AS ge, n_nationkey = n_regionkey AS eq, NOT (n_nationkey < 5) AS inv FROM nation")
def frame_compare(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    f = n[["n_nationkey"]].rename(columns={"n_nationkey": "k"})
    f = Frame(n.sdf.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")), ["k"], ["id"], ["id"])
    r = Frame(f.sdf.select("id", F.col("r").alias("k")), ["k"], ["id"], ["id"])
    got = {"lt": f.lt(5), "ge": f.ge(5), "eq": f.eq(r), "inv": ~f.lt(5)}
    out = None
    for name, g in got.items():
        one = g.to_spark(index=True).withColumnRenamed("k", name)
        out = one if out is None else out.join(one, "id")
    return out


@query("SELECT n_nationkey AS id, n_nationkey + 100 AS n_nationkey, n_regionkey + 7 AS n_regionkey FROM nation")
def add_by_column_labels(spark, sf_dir):
    f = Frame(_table(spark, sf_dir, "nation").sdf.withColumn("id", F.col("n_nationkey")), ["n_nationkey", "n_regionkey"], ["id"], ["id"])
    return f.add(series(spark, [100, 7], index=["n_nationkey", "n_regionkey"]), axis="columns").to_spark(index=True)


@query("SELECT n_nationkey, n_nationkey * (r_regionkey + 1) AS v FROM nation JOIN region ON n_regionkey = r_regionkey")
def mul_by_level(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation").sdf, _table(spark, sf_dir, "region").sdf
    a = Frame(n.select("n_regionkey", "n_nationkey", F.col("n_nationkey").alias("v")), ["v"], ["n_regionkey", "n_nationkey"], ["n_nationkey"])
    b = Frame(r.select("r_regionkey", (F.col("r_regionkey") + 1).alias("v")), ["v"], ["r_regionkey"], ["r_regionkey"])
    return a.mul(b, level="n_regionkey").to_spark(index=True).select("n_nationkey", "v")


@query("SELECT c_custkey, c_acctbal / 4 AS t, pow(2, c_nationkey % 3) AS p FROM customer")
def truediv_rpow(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.assign(t=c["c_acctbal"].truediv(4), p=2 ** (c["c_nationkey"] % 3))[["c_custkey", "t", "p"]].to_spark()


# -- joins
@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_right_index(spark, sf_dir):
    r = _table(spark, sf_dir, "region").set_index("r_regionkey")
    return _table(spark, sf_dir, "nation").merge(r, left_on="n_regionkey", right_index=True, validate="many_to_one")[["n_nationkey", "r_name"]].to_spark()


@query("SELECT 'one_to_one' AS how, true AS refused UNION ALL SELECT 'many_to_one', false")
def merge_validate(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")

    def refused(how):
        try:
            n.merge(r, left_on="n_regionkey", right_on="r_regionkey", validate=how)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(h, refused(h)) for h in ("one_to_one", "many_to_one")], "how string, refused boolean")


@query("SELECT n_nationkey AS k, n_regionkey AS a, coalesce(r_regionkey, -1) AS b FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def align_frames(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation").sdf, _table(spark, sf_dir, "region").sdf
    a = Frame(n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v")), ["v"], ["k"], ["k"])
    b = Frame(r.select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").alias("v")), ["v"], ["k"], ["k"])
    x, y = a.align(b, join="left", fill_value=-1)
    return x.to_spark(index=True).withColumnRenamed("v", "a").join(y.to_spark(index=True).withColumnRenamed("v", "b"), "k")


# -- functions of the user
@query("SELECT r_regionkey, r_regionkey * 2 + length(r_name) AS v FROM region")
def apply_rows_native(spark, sf_dir):
    r = _table(spark, sf_dir, "region")
    return r.assign(v=r.apply(lambda x: x["r_regionkey"] * 2 + F.length(x["r_name"]), axis=1))[["r_regionkey", "v"]].to_spark()


@query("SELECT max(p_size) - min(p_size) AS p_size, max(p_retailprice) - min(p_retailprice) AS p_retailprice FROM part")
def apply_columns(spark, sf_dir):
    got = _table(spark, sf_dir, "part")[["p_size", "p_retailprice"]].apply(lambda c: F.max(c) - F.min(c))
    return spark.createDataFrame([got], "p_size long, p_retailprice double")


@query("SELECT r_regionkey, length(r_name) + 0.5::DOUBLE AS v FROM region")
def applymap_python(spark, sf_dir):
    r = _table(spark, sf_dir, "region")
    return r[["r_name"]].applymap(lambda x: len(x) + 0.5).sdf.select("r_regionkey", F.col("r_name").cast("double").alias("v"))


@query("SELECT 'k' || n_nationkey AS label, n_name FROM nation")
def rename_labels(spark, sf_dir):
    f = _table(spark, sf_dir, "nation")
    f = f.assign(key=f["n_nationkey"].astype("str")).set_index("key")[["n_name"]]
    return f.rename(index=lambda k: "k" + k).to_spark(index=True).toDF("label", "n_name")


# -- sources, sinks, session
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path = _path(spark, "csv")
    _table(spark, sf_dir, "nation").to_csv(path, index=False)
    return read_csv(spark, path).to_spark()


@query("SELECT v AS a, v * 2 AS b FROM (SELECT unnest(range(3, 8)) AS v)")
def csv_skiprows(spark, sf_dir):
    """Lines ahead of the header, and values as the format writes them."""
    path = _path(spark, "csv")
    lines = ["note: made by hand", "and a second line", "a,b", *(f"{v},{v * 2}" for v in range(3, 8))]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    again = _path(spark, "csv")
    read_csv(spark, path, skiprows=2).astype({"a": "float"}).to_csv(again, index=False, float_format="%.1f")
    return read_csv(spark, again).astype("int64").to_spark()


@query("SELECT r_regionkey, r_name FROM region")
def feather_round_trip(spark, sf_dir):
    import tempfile

    from pyarrow import feather

    with tempfile.NamedTemporaryFile(suffix=".feather") as f:
        feather.write_feather(_table(spark, sf_dir, "region").sdf.select("r_regionkey", "r_name").toArrow(), f.name)
        return read_feather(spark, f.name, columns=["r_regionkey", "r_name"]).to_spark()


@query("SELECT n_nationkey AS k, n_nationkey * 2 AS a, n_nationkey * 2 + 1 AS b, n_name AS c FROM nation")
def local_sources(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    k = n["n_nationkey"].to_numpy()
    a = from_numpy(spark, np.stack([k * 2, k * 2 + 1], 1).astype("int64"), columns=["a", "b"]).assign(k=k.tolist())
    c = from_pandas(spark, pd.DataFrame({"k": k.astype("int64"), "c": n["n_name"].to_list()}))
    return a.merge(c, on="k")[["k", "a", "b", "c"]].to_spark()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def parquet_columns(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_totalprice"]).to_spark()


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10")
def channel_round_trip(spark, sf_dir):
    path = _path(spark, "channel")
    DataSender(path, num_shards=5).send(_table(spark, sf_dir, "nation"))
    receiver = DataReceiver(spark, path, shard_id=2)
    assert receiver.peek().count() == 5
    return receiver.recv().select("n_nationkey")


@query("SELECT n_regionkey, count(*) AS n, sum(n_nationkey)::BIGINT AS s FROM nation GROUP BY 1")
def csv_stream(spark, sf_dir):
    """A folder of CSV files read as a stream, written as one, and reduced by key."""
    src, out, mark = (_path(spark, x) for x in ("stream-in", "stream-out", "stream-mark"))
    _table(spark, sf_dir, "nation").sdf.repartition(3).write.option("header", True).csv(src)
    schema = "n_nationkey int, n_name string, n_regionkey int"
    csv_sink(csv_source(spark, src, schema), out, mark).awaitTermination()
    return reduce_by_key(spark.read.schema(schema).csv(out), "n_regionkey", F.count("*").alias("n"), F.sum("n_nationkey").alias("s"))


@query("SELECT 'local' AS process, true AS adaptive, 17 AS shape, true AS timed, count(*) AS rows FROM nation")
def session_settings(spark, sf_dir):
    """Settings read back as set, in a session of their own: neither do the caller's count here nor are they touched."""
    own = spark.newSession()
    session.set_partition_shape(own, (17, 1))
    session.set_adaptive_concurrency(own, True)
    shape = session.get_partition_shape(own)[0]
    session.set_benchmark_mode(True)
    f = _table(spark, sf_dir, "nation").repartition(3)
    session.timed("nation", f.to_spark())
    session.set_benchmark_mode(False)
    row = (session.get_process_mode(spark), session.get_adaptive_concurrency(own), shape, session.snapshot(reset=True)["nation"]["runs"] == 1, len(f))
    return spark.createDataFrame([row], "process string, adaptive boolean, shape int, timed boolean, rows long")


@query("SELECT n_nationkey, TIMESTAMP '2020-01-01' + to_hours(n_nationkey) AS d, NULL::TIMESTAMP AS bad FROM nation")
def to_datetime_origin(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").sdf
    return n.select("n_nationkey", to_datetime(F.col("n_nationkey"), unit="h", origin="2020-01-01").alias("d"), to_datetime(F.lit("no date"), errors="coerce").alias("bad"))


@query("SELECT d FROM (SELECT unnest(generate_series(TIMESTAMP '2022-03-01', TIMESTAMP '2022-03-20', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6")
def date_range_business(spark, sf_dir):
    return date_range(spark, "2022-03-01", "2022-03-20", freq="B")
