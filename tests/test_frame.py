"""Frames, series and group-bys where their meaning differs from plain Spark's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.functions import ordered
from loomframe.functions.datetimes import date_range, spark_format, to_datetime
from loomframe.operators.frame import concat
from loomframe.operators.groupby import Grouper
from loomframe.plans.session import disable, enable, get_partition_shape, set_partition_shape
from loomframe.plans.store import explain
from loomframe.sources import from_dict, from_numpy, from_pandas, read_csv, read_feather, series
from loomframe.sources.channel import DataReceiver, DataSender, shard


@pytest.fixture(scope="module")
def pdf():
    return pd.DataFrame({"k": ["a", "b", "a", None, "b", "a"], "x": [3, 1, 4, 1, 5, 9], "y": [1.5, np.nan, 2.5, -3.0, np.nan, 0.0]})


@pytest.fixture(scope="module")
def f(spark, pdf):
    return from_pandas(spark, pdf)


def vals(s):
    return [None if isinstance(v, float) and np.isnan(v) else v for v in s.to_list()]


def test_round_trip(f, pdf):
    pd.testing.assert_frame_equal(f.to_pandas(), pdf, check_dtype=False)
    assert f.shape == (6, 3) and f.size == 18 and not f.empty and list(f) == ["k", "x", "y"]


def test_floored_division_and_zero(spark):
    s = from_dict(spark, {"a": [-7, 7, 7, 0], "b": [2, -2, 0, 5]})
    assert vals(s["a"] // s["b"]) == [-4, -4, None, 0]
    assert vals(s["a"] % s["b"]) == [1, -1, None, 0]
    assert vals(s["a"] / s["b"]) == [-3.5, -3.5, None, 0]
    assert vals(1 - s["a"]) == [8, -6, -6, 1]
    assert vals(s["a"].add(s["b"], fill_value=1)) == [-5, 5, 7, 5]


def test_nulls_compare_false(f):
    assert vals(f["y"] > 1) == [True, False, True, False, False, False]
    assert vals(f["y"] != 1.5) == [False, True, True, True, True, True]
    assert vals(f["y"].isin([None, 0.0])) == [False, True, False, False, True, True]


def test_statistics(f, pdf):
    got = f[["x", "y"]]
    for how in ("sum", "mean", "median", "min", "max", "std", "var", "count"):
        want = getattr(pdf[["x", "y"]], how)()
        have = getattr(got, how)()
        assert all(abs(have[c] - want[c]) < 1e-9 for c in ("x", "y")), how
    assert abs(f["x"].std(ddof=0) - pdf.x.std(ddof=0)) < 1e-9
    assert f["y"].where(f["x"] > 99).sum() == 0 and f["y"].where(f["x"] > 99).stat("sum", min_count=1) is None
    assert abs(f["x"].skew() - pdf.x.skew()) < 1e-9
    assert vals(got.sum(axis=1)) == pdf[["x", "y"]].sum(axis=1).tolist()
    assert np.allclose(vals(got.median(axis=1)), pdf[["x", "y"]].median(axis=1))
    assert np.allclose(vals(got.mean(axis=1)), pdf[["x", "y"]].mean(axis=1))
    table = got.agg(["min", "max"]).to_pandas()
    assert table.loc["max", "x"] == 9 and table.loc["min", "y"] == -3


def test_cumulative_keeps_holes(f, pdf):
    for how in ("cumsum", "cummin", "cummax", "cumprod"):
        want = getattr(pdf.y, how)()
        have = pd.Series([np.nan if v is None else v for v in vals(getattr(f["y"], how)())])
        pd.testing.assert_series_equal(have, want, check_names=False)


def test_running_over_many_ranges(spark):
    n = 5000
    v = np.random.default_rng(0).integers(-9, 9, n)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "v": v})).repartition(7)
    got = ordered.running(df, ["i"], {"s": ("sum", "v"), "m": ("max", "v"), "lo": ("min", "v"), "l": ("last", "v")}).orderBy("i").toPandas()
    assert (got.s == np.cumsum(v)).all() and (got.m == np.maximum.accumulate(v)).all() and (got.lo == np.minimum.accumulate(v)).all() and (got.l == v).all()
    pos = ordered.with_position(df, ["v", "i"]).toPandas().sort_values("__pos")
    assert (pos.__pos == np.arange(n)).all() if hasattr(pos, "__pos") else (pos["__pos"].to_numpy() == np.arange(n)).all()
    assert pos[["v", "i"]].apply(tuple, axis=1).is_monotonic_increasing
    for method in ("average", "min", "max", "dense", "first"):
        r = ordered.ranked(df, "v", {"r": method}, ties=["i"]).orderBy("i").toPandas().r
        assert (r == pd.Series(v).rank(method=method)).all(), method
    w = ordered.moving(df, ["i"], {"w": lambda w: F.sum("v").over(w.rowsBetween(-2, 1))}, 2, 1).orderBy("i").toPandas().w
    assert w.tolist() == [int(v[max(0, i - 2) : i + 2].sum()) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"ascending": False}, {"na_option": "top"}, {"na_option": "bottom"}, {"pct": True}, {"method": "dense", "pct": True}])
def test_rank(f, pdf, kw):
    have = pd.Series([np.nan if v is None else v for v in vals(f["y"].rank(**kw))])
    pd.testing.assert_series_equal(have, pdf.y.rank(**kw), check_names=False, check_dtype=False)


def test_fill(f, pdf):
    for method in ("ffill", "bfill"):
        for limit in (None, 1):
            have = f[["y"]].fillna(method=method, limit=limit).to_pandas()
            pd.testing.assert_frame_equal(have, getattr(pdf[["y"]], method)(limit=limit))
    assert f.fillna({"y": 0.0})["y"].sum() == 1.0
    assert f.fillna("z").to_pandas().k.tolist() == ["a", "b", "a", "z", "b", "a"]


def test_rolling(f, pdf):
    for kw in ({}, {"min_periods": 1}, {"center": True}):
        have = pd.Series([np.nan if v is None else v for v in vals(f["x"].rolling(3, **kw).sum())])
        pd.testing.assert_series_equal(have, pdf.x.rolling(3, **kw).sum(), check_names=False, check_dtype=False)


def test_order(f, pdf):
    got = f.sort_values(["k", "x"], ascending=[False, True]).to_pandas()
    assert got.x.tolist() == [1, 5, 3, 4, 9, 1]
    assert f.sort_values("y", na_position="first").to_pandas().x.tolist()[:2] == [1, 5]
    assert f.head(2).to_pandas().x.tolist() == [3, 1] and f.tail(2).to_pandas().x.tolist() == [5, 9]
    assert f.head(-4).to_pandas().x.tolist() == [3, 1] and f.tail(-4).to_pandas().x.tolist() == [5, 9]
    assert f.iloc[1:3].to_pandas().x.tolist() == [1, 4] and f.iloc[-1].to_pandas().x.tolist() == [9]
    assert f.iloc[::2].to_pandas().x.tolist() == [3, 4, 5] and f.iloc[[0, -1], [1]].to_pandas().x.tolist() == [3, 9]
    assert f[1:3].to_pandas().x.tolist() == [1, 4] and f[[True, False, False, False, False, True]].to_pandas().x.tolist() == [3, 9]
    with pytest.raises(TypeError):
        f.iloc["a"]
    assert f.iloc.set((0, [1]), 100).to_pandas().x.tolist()[0] == 100


def test_labels(spark):
    f = from_pandas(spark, pd.DataFrame({"v": [1, 2, 3, 4]}, index=["a", "b", "c", "b"]))
    assert f.loc["b"].to_pandas().v.tolist() == [2, 4]
    assert f.loc["a":"c"].to_pandas().v.tolist() == [1, 2, 3]
    with pytest.raises(KeyError):
        f.loc["z"]
    assert f.drop("b").to_pandas().v.tolist() == [1, 3]
    with pytest.raises(KeyError):
        f.drop("z")
    assert f.drop("z", errors="ignore").to_pandas().v.tolist() == [1, 2, 3, 4]
    assert f.loc.set((f["v"] > 2, "v"), 0).to_pandas().v.tolist() == [1, 2, 0, 0]
    assert f.reindex(["c", "z"], fill_value=9).to_pandas().v.tolist() == [3, 9]
    assert f.rename(index={"a": "A"}).to_pandas().index.tolist() == ["A", "b", "c", "b"]
    with pytest.raises(ValueError):
        f.reset_index().set_index("level_0", verify_integrity=True)
    assert f.set_axis(["w"], axis=1).columns == ["w"]


def test_alignment(spark):
    a = from_pandas(spark, pd.DataFrame({"v": [1, 2, 3]}, index=["a", "b", "c"]))
    b = from_pandas(spark, pd.DataFrame({"v": [10, 20]}, index=["b", "d"]))
    got = (a + b).to_pandas().v
    assert got["b"] == 12 and got.isna().sum() == 3 and sorted(got.index) == ["a", "b", "c", "d"]
    x, y = a.align(b, join="inner")
    assert x.to_pandas().v.tolist() == [2] and y.to_pandas().v.tolist() == [10]
    assert a.combine(b, F.greatest, fill_value=0).to_pandas().v.to_dict() == {"a": 1, "b": 10, "c": 3, "d": 20}
    assert a.equals(a.copy()) and not a.equals(b)
    assert (a["v"] + b["v"]).to_frame("v").to_pandas().v.notna().sum() == 1


def test_duplicates(spark):
    p = pd.DataFrame({"a": [1, 1, None, None, 2], "b": [1, 2, 3, 3, 1]})
    f = from_pandas(spark, p)
    for keep in ("first", "last", False):
        assert vals(f.duplicated(["a"], keep)) == p.duplicated(["a"], keep).tolist()
        pd.testing.assert_frame_equal(f.drop_duplicates(keep=keep).to_pandas(), p.drop_duplicates(keep=keep).reset_index(drop=True), check_dtype=False)


def test_merge(spark):
    a = from_dict(spark, {"k": [1.0, 2.0, None], "v": [1, 2, 3]})
    b = from_dict(spark, {"k": [2.0, None, 4.0], "v": [20, 30, 40]})
    got = a.merge(b, on="k").to_pandas()
    assert got.columns.tolist() == ["k", "v_x", "v_y"] and sorted(got.v_x) == [2, 3]
    got = a.merge(b, how="outer", on="k", indicator=True).to_pandas()
    assert sorted(got._merge) == ["both", "both", "left_only", "right_only"]
    assert len(a.merge(b, how="cross")) == 9
    with pytest.raises(ValueError):
        concat([a, a], ignore_index=True).merge(b, on="k", validate="one_to_one")
    assert a.merge(b, left_index=True, right_index=True).to_pandas().v_y.tolist() == [20, 30, 40]


def test_concat(spark):
    a, b = from_dict(spark, {"x": [1]}), from_dict(spark, {"x": [2], "y": [3]})
    got = concat([a, b]).to_pandas()
    assert sorted(got.columns) == ["x", "y"] and len(got) == 2
    assert concat([a, b], join="inner").columns == ["x"]
    assert a.append(b, ignore_index=True).shape == (2, 2)
    with pytest.raises(ValueError):
        concat([a, b], verify_integrity=True)
    assert concat({"p": a, "q": b}).to_pandas().index.get_level_values(0).tolist() == ["p", "q"]


@pytest.mark.parametrize("how", ["sum", "mean", "median", "std", "var", "min", "max", "count", "prod", "nunique", "sem", "first", "last", "idxmax", "idxmin", "skew"])
def test_groupby_aggregates(f, pdf, how):
    p = pdf[["k", "x", "y"]].dropna(subset=["k"]) if how.startswith("idx") else pdf
    if how.startswith("idx"):
        p = p.dropna()
        f = f.dropna(subset=["k", "y"])
        want = p.reset_index(drop=True).groupby("k")[["x"]].agg(how)
        have = f.reset_index(drop=True).groupby("k")[["x"]].__getattribute__(how)().to_pandas()
    else:
        want = getattr(p.groupby("k"), how)()
        have = getattr(f.groupby("k"), how)().to_pandas()
    pd.testing.assert_frame_equal(have[want.columns], want, check_dtype=False, check_names=False)


@pytest.mark.parametrize("how", ["cumsum", "cummax", "shift", "diff", "rank", "ffill", "bfill"])
def test_groupby_transforms(f, pdf, how):
    p = pdf[pdf.k.notna()]
    want = getattr(p.groupby("k")[["x", "y"]], how)().reset_index(drop=True)
    have = getattr(f.groupby("k")[["x", "y"]], how)().to_pandas()
    pd.testing.assert_frame_equal(have[["x", "y"]].reset_index(drop=True), want, check_dtype=False)


def test_groupby_rest(f, pdf, spark):
    g = f.groupby("k")
    assert g.ngroups == 2 and g.indices == {"a": [0, 1, 3], "b": [2, 4]} or set(g.indices) == {"a", "b"}
    assert {k: len(x) for k, x in g} == {"a": 3, "b": 2}
    assert g.head(1).to_pandas().x.tolist() == [3, 1] and g.tail(1).to_pandas().x.tolist() == [5, 9]
    assert g.nth(1).to_pandas().x.tolist() == [4, 5]
    assert g.filter(lambda g: F.sum("x") > 10).to_pandas().x.tolist() == [3, 4, 9]
    assert vals(g.cumcount()) == [0, 0, 1, 1, 2] and sorted(vals(g.ngroup())) == [0, 0, 0, 1, 1]
    assert len(g.sample(n=1)) == 2
    want = pdf.groupby("k").x.apply(lambda s: (s - s.mean()).abs().mean())
    assert np.allclose(g["x"].mad().to_pandas().x, want)
    assert np.allclose(g.quantile(0.25).to_pandas().x, pdf.groupby("k").x.quantile(0.25))
    assert g.describe().to_pandas()["x_50%"].tolist() == pdf.groupby("k").x.median().tolist()
    c = g[["x", "y"]].cov().to_pandas().loc[("a", "x"), "y"]
    assert abs(c - pdf.groupby("k")[["x", "y"]].cov().loc[("a", "x"), "y"]) < 1e-9
    assert f.groupby("k", dropna=False).ngroups == 3
    assert g.agg(total=("x", "sum"), top=("y", "max")).to_pandas().total.tolist() == [16, 6]
    assert g["x"].agg_udf(lambda s: float(s.sum())).to_pandas().x.tolist() == [16, 6]
    with pytest.raises(KeyError):
        f.groupby("nope")
    t = from_pandas(spark, pd.DataFrame({"t": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 05:00", "2024-01-03 00:00"]), "v": [1, 2, 3], "k": [1, 1, 1]}))
    assert t.groupby(Grouper("t", "D"))["v"].sum().to_pandas().v.tolist() == [3, 3]
    assert t.groupby("k")[["v"]].resample("D", on="t", how="sum", fill=True).to_spark().count() == 3


def test_reshape(spark):
    f = from_dict(spark, {"a": ["x", "x", "y"], "b": ["p", "q", "p"], "v": [1.0, 2.0, 3.0]})
    p = f.pivot_table(values="v", index="a", columns="b", aggfunc="sum", fill_value=0.0).to_pandas()
    assert p.loc["y", "q"] == 0 and p.loc["x", "q"] == 2
    m = f.pivot_table(values="v", index="a", columns="b", aggfunc="sum", margins=True).to_pandas()
    assert m.loc["All", "All"] == 6 and m.loc["x", "All"] == 3 and m.loc["All", "p"] == 4
    assert f.set_index(["a", "b"]).unstack().to_pandas().loc["x", "q"] == 2
    s = from_dict(spark, {"u": [1, None], "w": [3, 4]}).stack().to_pandas()
    assert s.value.tolist() == [1, 3, 4]
    e = from_dict(spark, {"i": [1, 2, 3], "l": [[1, 2], [], None]}).explode("l").to_pandas()
    assert len(e) == 4 and e.l.isna().sum() == 2
    t = from_dict(spark, {"u": [1, 2], "w": [3, 4]}).T.to_pandas()
    assert t.loc["w"].tolist() == [3, 4]


def test_replace_where_types(f, spark):
    assert f.replace({"a": "A"}).to_pandas().k.tolist()[0] == "A"
    assert f.replace([1, 9], [10, 90]).to_pandas().x.tolist() == [3, 10, 4, 10, 5, 90]
    assert f.replace("^a$", "A", regex=True).to_pandas().k.tolist()[0] == "A"
    assert vals(f["x"].replace(1, method="pad")) == [3, 3, 4, 4, 5, 9]
    assert vals(f["x"].where(f["x"] > 3)) == [None, None, 4, None, 5, 9] and vals(f["x"].mask(f["x"] > 3, 0)) == [3, 1, 0, 1, 0, 0]
    assert f.astype({"x": "str"}).dtypes["x"] == "string"
    with pytest.raises(Exception):
        from_dict(spark, {"s": ["1", "b"]}).astype("int64").to_pandas()
    assert from_dict(spark, {"s": ["1", "b"]}).astype("int64", errors="ignore").to_pandas().s.isna().sum() == 1
    assert f.dropna(axis=1).columns == ["x"] and len(f.dropna(how="all")) == 6 and len(f.dropna(thresh=3)) == 3
    assert vals(f["x"].apply(lambda v: v * 2.0)) == [6, 2, 8, 2, 10, 18]
    assert vals(f["k"].apply(lambda v: len(v) if v else 0, dtype="int64")) == [1, 1, 1, 0, 1, 1]
    assert f.insert(1, "z", 5).columns == ["k", "z", "x", "y"]
    with pytest.raises(ValueError):
        f.insert(0, "x", 1)
    assert f.assign(z=[1, 2, 3, 4, 5, 6]).to_pandas().z.tolist() == [1, 2, 3, 4, 5, 6]
    assert f["x"].value_counts().to_pandas()["count"].tolist()[0] == 2
    assert f["x"].head(1).item() == 3 and f["x"].to_dict()[5] == 9
    assert f.memory_usage()["x"] == 48


def test_datetimes(spark):
    assert spark_format("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    df = spark.createDataFrame([("31/12/2023", "2023-12-31", 86400), ("bad", "2024-02-29", 0)], "a string, b string, c long")
    got = df.select(to_datetime(F.col("a"), dayfirst=True, errors="coerce").alias("a"), to_datetime(F.col("b")).alias("b"), to_datetime(F.col("c"), unit="s").alias("c")).collect()
    assert str(got[0].a) == "2023-12-31 00:00:00" and got[1].a is None and str(got[1].b) == "2024-02-29 00:00:00" and str(got[0].c) == "1970-01-02 00:00:00"
    for kw in ({"start": "2024-01-31", "periods": 3, "freq": "M"}, {"start": "2024-01-01", "end": "2024-01-10", "freq": "3D"}, {"end": "2024-01-10", "periods": 3, "freq": "2h"}, {"start": "2024-01-05", "end": "2024-01-09", "freq": "B"}):
        want = pd.date_range(**{**kw, "freq": kw["freq"].replace("M", "ME")})
        assert [str(r[0]) for r in date_range(spark, **kw).orderBy("d").collect()] == [str(x) for x in want], kw
    assert date_range(spark, "2024-01-01", "2024-01-03", closed="left").count() == 2


def test_sources(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    p = pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y,z", None]})
    p.to_csv(tmp_path / "t.csv", index=False)
    f = read_csv(spark, str(tmp_path / "t.csv"))
    assert f.dtypes == {"a": "int", "b": "string"} and len(f) == 3
    assert read_csv(spark, str(tmp_path / "t.csv"), usecols=["a"], nrows=2).to_pandas().a.tolist() == [1, 2]
    f.to_csv(str(tmp_path / "out"), index=False)
    assert sorted(read_csv(spark, str(tmp_path / "out")).to_pandas().a) == [1, 2, 3]
    assert f[["a"]].to_csv(index=False).split() == ["a", "1", "2", "3"]
    feather.write_feather(pa.table({"a": [1, 2]}), str(tmp_path / "t.arrow"))
    assert len(read_feather(spark, str(tmp_path / "t.arrow"))) == 2
    assert from_numpy(spark, np.eye(2)).to_numpy().tolist() == [[1, 0], [0, 1]]
    assert series(spark, [5, 6], index=["p", "q"]).to_dict() == {"p": 5, "q": 6}


def test_channel(spark, tmp_path):
    f = from_dict(spark, {"a": list(range(6))})
    to = f"file://{tmp_path}/chan"
    s = DataSender(to, num_shards=3, max_queue_size=1)
    s.send(f)
    with pytest.raises(RuntimeError):
        s.send(f)
    assert [r.a for r in DataReceiver(spark, to, 1).recv().collect()] == [2, 3]
    r = DataReceiver(spark, to, 0)
    assert [x.a for x in r.peek().collect()] == [x.a for x in r.recv().collect()] == [0, 1]
    s.send(f)
    with pytest.raises(ValueError):
        shard(f, 4)
    assert shard(f, 2, full_batch=True).count() == 12


def test_streaming(spark, tmp_path):
    from loomframe import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("ts,k\n2024-01-01 00:00:00,1\n2024-01-01 00:30:00,1\n")
    (tmp_path / "in" / "b.csv").write_text("ts,k\n2024-01-01 01:10:00,2\n")
    src = streaming.csv_source(spark, str(tmp_path / "in"), "ts timestamp, k int")
    q = streaming.windowed(src, "ts", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["count"] for r in spark.table("w").collect()) == [1, 2]
    q = streaming.csv_sink(src, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.csv(str(tmp_path / "out")).count() == 3


def test_session(spark):
    was = get_partition_shape(spark)
    set_partition_shape(spark, (5, 2))
    assert get_partition_shape(spark) == (5, 1)
    set_partition_shape(spark, was)
    disable(spark, "constant_folding")
    assert "ConstantFolding" in spark.conf.get("spark.sql.optimizer.excludedRules")
    enable(spark, "constant_folding")
    assert "Range" in explain(spark.range(3))


def test_empty(spark):
    f = from_pandas(spark, pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="float64")}))
    assert f.empty and len(f.head()) == 0 and f.sum() == {"a": 0, "b": 0} and f.count() == {"a": 0, "b": 0}
    assert len(f.groupby("a").sum()) == 0 and len(f.sort_values("a")) == 0 and vals(f["a"].cumsum()) == [] and vals(f["b"].rank()) == []
    assert len(f.drop_duplicates()) == 0 and len(concat([f, f])) == 0


@pytest.fixture(scope="module")
def keyed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.8, "hot", rng.choice(list("abc"), n)), "v": rng.integers(0, 40, n).astype(float), "w": rng.integers(-5, 5, n).astype(float)})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    pdf.loc[rng.random(n) < 0.01, "k"] = None
    return pdf, from_pandas(spark, pdf)


def _same(got, want):
    got, want = pd.Series(got).reset_index(drop=True).astype(float), pd.Series(want).reset_index(drop=True).astype(float)
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_hot_groups_over_many_ranges(spark, keyed):
    """A group in most of the ranges: running values, ranks, shifts and fills go on from range to range."""
    pdf, f = keyed
    some = pdf[pdf.k.notna()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want, g = some.groupby("k"), f.groupby("k")
        for how in ("cumsum", "cummin", "cummax"):
            _same(getattr(g[["v"]], how)()["v"].to_list(), getattr(want.v, how)())
        for kw in ({}, {"method": "min", "ascending": False}, {"method": "first"}, {"method": "dense", "pct": True}, {"method": "max", "na_option": "bottom"}, {"na_option": "top", "ascending": False}):
            _same(g[["v"]].rank(**kw)["v"].to_list(), want.v.rank(**kw))
        for n in (1, 3, -2):
            _same(g[["v"]].shift(n)["v"].to_list(), want.v.shift(n))
            _same(g[["w"]].diff(n)["w"].to_list(), want.w.diff(n))
        _same(g[["v"]].ffill()["v"].to_list(), want.v.ffill())
        _same(g[["v"]].bfill()["v"].to_list(), want.v.bfill())
        _same(g[["v"]].bfill(limit=1)["v"].to_list(), want.v.bfill(limit=1))
        _same(g.cumcount().to_list(), want.cumcount())
        _same(g.cumcount(ascending=False).to_list(), want.cumcount(ascending=False))
        _same(g[["v"]].transform("mean")["v"].to_list(), want.v.transform("mean"))
        assert g.sample(frac=0.1).groupby("k").size().to_pandas().to_dict() == {k: round(0.1 * n) for k, n in want.size().items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_descending_and_ties(keyed):
    pdf, f = keyed
    for kw in ({"ascending": False}, {"ascending": False, "method": "dense", "pct": True}, {"ascending": False, "na_option": "top"}, {"ascending": False, "na_option": "bottom", "method": "max"}, {"method": "first", "ascending": False}, {"pct": True, "na_option": "bottom"}):
        _same(f[["v"]].rank(**kw)["v"].to_list(), pdf.v.rank(**kw))
    across = pdf[["v", "w"]]
    for kw in ({}, {"method": "dense"}, {"method": "first", "ascending": False}, {"na_option": "top"}, {"na_option": "bottom", "method": "min"}, {"pct": True}):
        got, want = f[["v", "w"]].rank(axis=1, **kw), across.rank(axis=1, **kw)
        for c in across:
            _same(got[c].to_list(), want[c])


def test_alignment_keeps_order(spark):
    a, b = from_dict(spark, {"v": [1, 2, 3]}, index=["c", "a", "b"]), from_dict(spark, {"v": [30, 10, 20]}, index=["b", "c", "a"])
    assert vals((a + b)["v"]) == [11, 22, 33] and [k for k, _ in (a + b).iterrows()] == ["c", "a", "b"]
    assert vals(((a + b) + a)["v"]) == [12, 24, 36]
    both = concat([a, b.rename(columns={"v": "w"})], axis=1)
    assert vals(both["v"]) == [1, 2, 3] and vals(both["w"]) == [10, 20, 30]


def test_cumulative_axis_and_skipna(spark):
    pdf = pd.DataFrame({"a": [1.0, np.nan, 3.0], "b": [np.nan, 2.0, 5.0], "c": [4.0, 1.0, 2.0]})
    f = from_pandas(spark, pdf)
    for how in ("cumsum", "cumprod", "cummin", "cummax"):
        for kw in ({"axis": 1}, {"skipna": False}, {"axis": 1, "skipna": False}):
            got, want = getattr(f, how)(**kw), getattr(pdf, how)(**kw)
            for c in pdf:
                _same(got[c].to_list(), want[c])


def test_set_in_place(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4], "b": [10, 20, 30, 40]}, index=list("wxyz"))
    f = from_pandas(spark, pdf)
    a = f["a"]
    f["a"] = 0
    assert vals(a) == [1, 2, 3, 4] and vals(f["a"]) == [0, 0, 0, 0]
    f["a"] = a * 2
    f["c"] = f["b"] + f["a"]
    f[["b", "d"]] = [f["a"], 7]
    assert vals(f["a"]) == [2, 4, 6, 8] and vals(f["b"]) == [2, 4, 6, 8] and vals(f["c"]) == [12, 24, 36, 48] and vals(f["d"]) == [7] * 4
    f[f > 40] = -1
    assert vals(f["c"]) == [12, 24, 36, -1]
    f.loc["x", "d"] = 0
    f.iloc[2:, 0] = 9
    assert vals(f["d"]) == [7, 0, 7, 7] and vals(f["a"]) == [2, 4, 9, 9]
    s = f["a"]
    s["w"] = 5
    s[s == 9] = 8
    assert vals(s) == [5, 4, 8, 8] and vals(f["a"]) == [2, 4, 9, 9]
    with pytest.raises(ValueError):
        f[["a", "b"]] = [1, 2, 3]


def test_where_and_mask_by_frames(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3], "b": [4, 5, 6]}, index=list("xyz"))
    f = from_pandas(spark, pdf)
    other = from_pandas(spark, pd.DataFrame({"a": [-1, -2], "b": [-3, -4]}, index=list("zx")))
    cond = from_pandas(spark, pd.DataFrame({"a": [True, False, True], "b": [False, True, True]}, index=list("zyx")))
    for name in ("where", "mask"):
        want = getattr(pdf, name)(cond.to_pandas(), other.to_pandas().reindex(pdf.index))
        got = getattr(f, name)(cond, other)
        for c in pdf:
            _same(got[c].to_list(), want[c])
        for args in ((lambda x: x > 2, lambda x: x * 10), (lambda x: x["a"] > 1, 0)):
            want = getattr(pdf, name)(*args) if name == "where" or args[1] == 0 else pdf.mask(*args)
            got = getattr(f, name)(*args)
            for c in pdf:
                _same(got[c].to_list(), want[c])
    assert vals(f["a"].where(f["b"] > 4, 0)) == [0, 2, 3]


def test_levels_and_axes(spark):
    pdf = pd.DataFrame({"g": list("aabb"), "i": [1, 2, 1, 2], "v": [1, 2, 3, 4], "w": [5.0, 6.0, 7.0, 8.0]}).set_index(["g", "i"])
    f = from_pandas(spark, pdf)
    for how in ("sum", "max", "mean", "count"):
        assert getattr(f, how)(level="g").to_pandas()["v"].tolist() == getattr(pdf.groupby(level="g"), how)()["v"].tolist()
    assert f["v"].sum(level=1).to_pandas()["v"].tolist() == [4, 6]
    by = from_pandas(spark, pd.DataFrame({"v": [10, 20], "w": [1.0, 2.0]}, index=pd.Index(["a", "b"], name="g")))
    assert vals(f.add(by, level="g")["v"]) == [11, 12, 23, 24] and vals(f.gt(by, level=0)["w"]) == [True] * 4
    assert f.drop(index=["a"], level="g")["v"].to_list() == [3, 4]
    one = from_pandas(spark, pd.DataFrame({"x": [3, 1], "y": [1, 2]}, index=["p", "q"]))
    assert one.sort_values("p", axis=1).columns == ["y", "x"] and one.sort_values("q", axis=1).columns == ["x", "y"]
    moved = one.sort_values("x")
    assert [k for k, _ in moved.iterrows()] == ["q", "p"] and moved.head(1)["y"].to_list() == [2]
    plain = from_pandas(spark, pd.DataFrame({"x": [3, 1, 2]})).sort_values("x")
    assert plain.loc[1]["x"].to_list() == [1] and vals(plain["x"]) == [1, 2, 3]


def test_functions_of_groups_and_values(spark):
    pdf = pd.DataFrame({"k": list("aabbb"), "v": [1.0, 2, 3, 4, 5]})
    f = from_pandas(spark, pdf)
    assert f.groupby("k").filter(lambda g: len(g) > 2)["v"].to_list() == [3, 4, 5]
    assert f.groupby("k").filter(lambda g: F.count("*") > 2)["v"].to_list() == [3, 4, 5]
    assert f.groupby("k")[["v"]].transform(lambda s: s - s.mean())["v"].to_list() == [-0.5, 0.5, -1, 0, 1]
    assert sorted(r[0] for r in f.groupby("k").apply(lambda g: pd.DataFrame({"m": [g.v.max()]})).collect()) == [2, 5]
    assert f.set_index("v").groupby(lambda x: x > 2).size().to_pandas().tolist() == [2, 3]
    with pytest.raises(NameError):
        f[["v"]].applymap(lambda x: no_such_name(x))  # noqa: F821
    assert f["v"].apply(lambda x: round(x) + 1).to_list() == [2, 3, 4, 5, 6]
