"""The registered queries over the driver's tables, each through the library's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.datetimes import date_range, to_datetime
from .operators.frame import Frame, concat
from .sources import from_spark
from .sources.channel import shard

# Columns that order a table; where rows repeat them the query orders nothing.
ORDER = {"orders": ["o_orderkey"], "events": ["event_id"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "embeddings": ["vec_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return from_spark(spark.read.parquet(f"{sf_dir}/{name}.parquet"), order=ORDER.get(name, ()))



def flagship_clean_group(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    g = lineitem.filter(lineitem["l_returnflag"] == "R").groupby("l_linestatus", as_index=False)
    return g.agg(n=("l_quantity", "size"), qty=("l_quantity", "sum")).to_spark()


def project_select(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem[["l_orderkey", "l_quantity"]][lineitem["l_quantity"] <= 6].to_spark()


def isin_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.assign(hot=orders["o_orderpriority"].isin(["1-URGENT", "2-HIGH"]))[["o_orderkey", "hot"]].to_spark()


def isna_notna(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    v = events["value"]
    return events.assign(is_na=v.isna(), not_na=v.notna())[["event_id", "is_na", "not_na"]].to_spark()


def comp_ops(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    p, s = orders["o_totalprice"], orders["o_orderstatus"]
    return orders.assign(gt=p > 1000, le=p <= 1000, eq=s == "F", ne=s != "F")[["o_orderkey", "gt", "le", "eq", "ne"]].to_spark()


def math_ops(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    p = orders["o_totalprice"]
    return orders.assign(a=p + 1, s=p - 1, m=p * 2, d=p / 2)[["o_orderkey", "a", "s", "m", "d"]].to_spark()


def floordiv_mod(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    b = customer["c_acctbal"]
    return customer.assign(fd=(b // 7).astype("float"), md=b % 7)[["c_custkey", "fd", "md"]].to_spark()


def abs_pow(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.assign(a=customer["c_acctbal"].abs(), p=customer["c_nationkey"] ** 2)[["c_custkey", "a", "p"]].to_spark()


def where_mask(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    b = customer["c_acctbal"]
    return customer.assign(w=b.where(b > 0), m=b.mask(b > 0, 0.0))[["c_custkey", "w", "m"]].to_spark()


def fillna_value(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events[["event_id", "value"]].fillna({"value": -1.0}).rename(columns={"value": "v"}).to_spark()


def fillna_ffill(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    v = events["value"]
    f = events.assign(v=v.where(events["event_id"] % 3 == 0))[["event_id", "v"]]
    return f.fillna(method="ffill").to_spark()


def fillna_bfill(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    v = events["value"]
    f = events.assign(v=v.where(events["event_id"] % 3 == 0))[["event_id", "v"]]
    return f.fillna(method="bfill").to_spark()


def replace_map(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    f = orders.assign(s=orders["o_orderstatus"])[["o_orderkey", "s"]]
    return f.replace({"s": {"F": "done", "O": "open"}}).to_spark()


def replace_regex(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part[["p_partkey", "p_name"]].replace("[aeiou]", "", regex=True).rename(columns={"p_name": "n"}).to_spark()


def dropna_any(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events[["event_id", "value"]].dropna().to_spark()


def astype_cast(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    k = orders["o_orderkey"]
    return orders.assign(s=k.astype("str"), i=k.astype("int32"))[["o_orderkey", "s", "i"]].to_spark()


def rename_drop(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.drop(columns="n_regionkey").rename(columns={"n_nationkey": "id", "n_name": "name"}).to_spark()


def merge_inner(spark, sf_dir):
    customer, orders = (table(spark, sf_dir, t) for t in ["customer", "orders"])
    return customer.merge(orders, how="inner", left_on="c_custkey", right_on="o_custkey")[["c_custkey", "o_orderkey"]].to_spark()


def merge_left(spark, sf_dir):
    customer, orders = (table(spark, sf_dir, t) for t in ["customer", "orders"])
    return customer.merge(orders, how="left", left_on="c_custkey", right_on="o_custkey")[["c_custkey", "o_orderkey"]].to_spark()


def merge_right(spark, sf_dir):
    orders, customer = (table(spark, sf_dir, t) for t in ["orders", "customer"])
    return orders.merge(customer, how="right", left_on="o_custkey", right_on="c_custkey")[["c_custkey", "o_orderkey"]].to_spark()


def merge_outer(spark, sf_dir):
    supplier, nation = (table(spark, sf_dir, t) for t in ["supplier", "nation"])
    m = supplier.merge(nation, how="outer", left_on="s_nationkey", right_on="n_nationkey")
    return m.to_spark().select(F.coalesce("s_nationkey", "n_nationkey").alias("k"), "s_suppkey", "n_name")


def merge_cross(spark, sf_dir):
    region, nation = (table(spark, sf_dir, t) for t in ["region", "nation"])
    return region.merge(nation, how="cross")[["r_name", "n_name"]].to_spark()


def merge_indicator(spark, sf_dir):
    nation, supplier = (table(spark, sf_dir, t) for t in ["nation", "supplier"])
    s = from_spark(supplier.sdf.select("s_nationkey").distinct())
    return nation.merge(s, how="left", left_on="n_nationkey", right_on="s_nationkey", indicator="m")[["n_nationkey", "m"]].to_spark()


def merge_select_push(spark, sf_dir):
    orders, customer = (table(spark, sf_dir, t) for t in ["orders", "customer"])
    m = orders.merge(customer, left_on="o_custkey", right_on="c_custkey")
    return m[m["c_nationkey"] >= 10][["o_orderkey", "c_name"]].to_spark()


def group_select_push(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    g = customer.groupby("c_nationkey", as_index=False).size()
    return g[g["c_nationkey"] < 4].rename(columns={"size": "n"}).to_spark()


def stats_frame(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    names = {"max": "mx", "min": "mn", "count": "n", "mean": "mean", "median": "med", "std": "sd", "var": "vr"}
    rows = lineitem[["l_quantity"]].agg(list(names)).sdf
    one = {n: F.max(F.when(F.col("func") == f, F.col("l_quantity"))) for f, n in names.items()}
    return rows.agg(*(e.cast("long").alias(n) if n == "n" else F.round(e, 6).alias(n) if n in ("mean", "sd", "vr") else e.alias(n) for n, e in one.items()))


def prod_any_all(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    k = region["r_regionkey"]
    f = region.assign(p=k + 1, a=k > 3, b=k >= 0)
    return spark.createDataFrame([(f[["p"]].prod()["p"], f[["a"]].any()["a"], f[["b"]].all()["b"])], "p double, a boolean, b boolean")


def stats_axis1(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    s, g = lineitem[["l_quantity", "l_tax", "l_discount"]].sum(axis=1), lineitem[["l_quantity", "l_tax"]].max(axis=1)
    return lineitem.sdf.select("l_orderkey", "l_linenumber", s.expr.alias("s"), g.expr.alias("g"))


def value_counts_norm(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    n = orders["o_orderpriority"].value_counts(sort=False)
    f = orders["o_orderpriority"].value_counts(normalize=True, sort=False)
    return n.sdf.select(F.col("value").alias("o_orderpriority"), F.col("count").alias("n")).join(f.sdf.select(F.col("value").alias("o_orderpriority"), F.col("count").alias("f")), "o_orderpriority")


def gb_agg_all(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    g = lineitem.groupby("l_returnflag", as_index=False)
    out = g.agg(s=("l_tax", "sum"), c=("l_tax", "count"), n=("l_tax", "size"), mn=("l_tax", "min"), mx=("l_tax", "max"))
    return out.to_spark().withColumn("s", F.round("s", 4))


def gb_multikey(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.groupby(["l_returnflag", "l_linestatus"], as_index=False).size().rename(columns={"size": "n"}).to_spark()


def gb_moments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    g = orders.groupby("o_orderstatus", as_index=False).agg(sd=("o_totalprice", "std"), se=("o_totalprice", "sem"), sk=("o_totalprice", "skew"))
    return g.to_spark().select("o_orderstatus", *(F.round(c, 4).alias(c) for c in ("sd", "se", "sk")))


def gb_quantile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    q = orders.groupby("o_orderstatus", as_index=False)[["o_totalprice"]].quantile([0.5, 0.25]).to_spark()
    return q.toDF("o_orderstatus", "md", "q")


def gb_nunique(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupby("o_orderpriority", as_index=False)["o_custkey"].nunique().rename(columns={"o_custkey": "n"}).to_spark()


def gb_mad(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    g = orders.groupby("o_orderstatus", as_index=False)["o_totalprice"].mad()
    return g.to_spark().select("o_orderstatus", F.round("o_totalprice", 4).alias("mad"))


def gb_first_last(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    g = events.groupby("user_id", as_index=False)["value"].ohlc()
    return g.to_spark().select("user_id", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))


def gb_idx(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.set_index("o_orderkey", drop=False).groupby("o_custkey", as_index=False)["o_totalprice"].idxmax().rename(columns={"o_totalprice": "imax"}).to_spark()


def gb_head(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupby("o_custkey").head(2)[["o_custkey", "o_orderkey"]].to_spark()


def gb_cum(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    g = events.groupby("user_id")
    m = g["value"].cummax()
    cc = g.cumcount()
    return cc.frame.sdf.select("event_id", F.col("cumcount").alias("cc")).join(m.sdf.select("event_id", F.col("value").alias("cm")), "event_id")


def gb_shift_diff(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    g = events.groupby("user_id")["value"]
    return g.shift().sdf.select("event_id", F.col("value").alias("s")).join(g.diff().sdf.select("event_id", F.col("value").alias("d")), "event_id")


def gb_pct_change(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupby("user_id")["value"].pct_change().sdf.select("event_id", F.col("value").alias("p"))


def gb_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupby("o_orderstatus")["o_totalprice"].rank().sdf.select("o_orderkey", F.col("o_totalprice").alias("r"))


def gb_ngroup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupby("o_orderpriority").ngroup().frame.sdf.select("o_orderkey", F.col("ngroup").alias("g"))


def gb_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupby("o_custkey").filter(lambda g: F.count("*") > 10)[["o_orderkey"]].to_spark()


def gb_resample(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = events[["user_id", "ts", "event_id"]].groupby("user_id").resample("D", on="ts", how="count")
    return out.to_spark().select("user_id", F.col("ts").alias("d"), F.col("event_id").alias("n"))


def gb_corr_cov(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    g = lineitem.groupby("l_returnflag")
    r = g[["l_quantity", "l_extendedprice"]].corr().sdf.where("variable = 'l_quantity'").select("l_returnflag", F.round("l_extendedprice", 6).alias("r"))
    return r.join(g[["l_quantity", "l_tax"]].cov().sdf.where("variable = 'l_quantity'").select("l_returnflag", F.round("l_tax", 6).alias("cv")), "l_returnflag")


def rolling_sum(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    m = events["value"].rolling(3).max()
    return m.frame.sdf.select("event_id", F.col("__v").alias("m"))


def cum_ops(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders[["o_orderkey", "o_custkey", "o_totalprice"]].running(cs=("o_custkey", "sum"), cx=("o_totalprice", "max"), cn=("o_totalprice", "min"))[["o_orderkey", "cs", "cx", "cn"]].to_spark()


def rank_methods(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part[["p_partkey", "p_size"]].ranks("p_size", mn="min", ds="dense", f="first")[["p_partkey", "mn", "ds", "f"]].to_spark()


def sort_head(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").set_index("o_orderkey", drop=False)
    return orders.sort_values("o_totalprice", ascending=False).head(20)[["o_orderkey", "o_totalprice"]].to_spark()  # one top-k, no full sort


def iloc_slice(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.iloc[10:20][["o_orderkey"]].to_spark()


def duplicated_flag(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.duplicated("o_custkey").frame.sdf.select("o_orderkey", F.col("__dup").alias("dup"))


def drop_duplicates_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.drop_duplicates("o_custkey")[["o_custkey", "o_orderkey"]].to_spark()


def concat_axis0(spark, sf_dir):
    nation, region = (table(spark, sf_dir, t) for t in ["nation", "region"])
    a = nation[["n_nationkey", "n_name"]].rename(columns={"n_nationkey": "k", "n_name": "name"})
    b = region.rename(columns={"r_regionkey": "k", "r_name": "name"})
    return concat([a, b], ignore_index=True).to_spark()


def concat_axis1(spark, sf_dir):
    nation, region = (table(spark, sf_dir, t) for t in ["nation", "region"])
    a = nation.set_index("n_nationkey").rename(columns={})[["n_name"]]
    b = region.set_index("r_regionkey")[["r_name"]]
    return concat([a, b], axis=1).to_spark(index=True).withColumnRenamed("n_nationkey", "k")


def pivot_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    p = orders.pivot_table(values="o_orderkey", index="o_orderpriority", columns="o_orderstatus", aggfunc="count", fill_value=0, labels=["F", "O", "P"])
    return p.to_spark(index=True).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


def pivot_margins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    p = orders.pivot_table(values="o_orderkey", index="o_orderstatus", columns="o_orderpriority", aggfunc="count", fill_value=0, margins=True)
    return p.to_spark(index=True).unpivot("o_orderstatus", p.columns, "p", "n").withColumnRenamed("o_orderstatus", "s")


def stack_unpivot(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    f = Frame(nation.sdf.withColumn("id", F.col("n_nationkey")), ["n_regionkey", "n_nationkey"], ["id"], ["id"]).stack()
    return f.sdf.select(F.col("id").alias("n_nationkey"), F.col("variable").alias("var"), F.col("value").alias("v"))


def explode_list(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings[["vec_id", "embedding"]].explode("embedding").rename(columns={"embedding": "x"}).to_spark()


def to_datetime_parse(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.sdf.select("o_orderkey", to_datetime(text, format="%Y-%m-%d").alias("d"))


def date_range_daily(spark, sf_dir):
    return date_range(spark, "2022-01-01", "2022-01-31", freq="D")


def applymap_native(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    f = part[["p_partkey", "p_brand"]].assign(n=part["p_name"].apply(F.length).astype("int64"))
    return f[["p_brand"]].applymap(F.upper).sdf.select("p_partkey", F.col("p_brand").alias("b"), "n")


def reindex_labels(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    f = nation.set_index("n_nationkey")[["n_name"]].reindex(list(range(20, 30)), fill_value="none")
    return f.to_spark(index=True).select(F.col("n_nationkey").cast("int").alias("k"), "n_name")


def combine_min(spark, sf_dir):
    nation, region = (table(spark, sf_dir, t) for t in ["nation", "region"])
    a = Frame(nation.sdf.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v")), ["v"], ["k"], ["k"])
    b = Frame(region.sdf.select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").alias("v")), ["v"], ["k"], ["k"])
    return a.combine(b, F.least).to_spark(index=True)


def gb_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    got = orders.groupby("o_orderstatus").sample(n=3, random_state=7)
    again = orders.groupby("o_orderstatus").sample(n=3, random_state=7)
    return got.merge(again[["o_orderkey"]], on="o_orderkey").groupby("o_orderstatus", as_index=False).size().to_spark()


def gb_apply_udf(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.groupby("n_regionkey").apply(lambda g: g.nlargest(1, "n_nationkey")[["n_regionkey", "n_name"]], "n_regionkey int, n_name string")


def apply_axis1_udf(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    return region.sdf.select("r_regionkey", region.apply(lambda r: len(r["r_name"]) + r["r_regionkey"], axis=1, dtype="int64").expr.alias("v"))


def channel_shards(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return shard(nation, 5).groupBy("shard").agg(F.count("*").alias("n"), F.min("n_nationkey").alias("lo"), F.max("n_nationkey").alias("hi"))


def memory_usage(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return spark.createDataFrame(sorted(nation.memory_usage(deep=True).items()), "column string, bytes long")


def gb_first_nth_tail(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    g = orders.groupby("o_custkey")
    second, last = g.nth(1), g.tail(1)
    return second[["o_custkey", "o_orderkey"]].to_spark().withColumnRenamed("o_orderkey", "second").join(last[["o_custkey", "o_orderkey"]].to_spark().withColumnRenamed("o_orderkey", "last"), "o_custkey")


def gb_describe(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    d = orders.groupby("o_orderstatus", as_index=False)[["o_totalprice"]].describe().to_spark()
    return d.select("o_orderstatus", F.col("o_totalprice_count").alias("n"), F.col("o_totalprice_min").alias("mn"), F.col("`o_totalprice_25%`").alias("q1"), F.col("`o_totalprice_50%`").alias("md"), F.col("`o_totalprice_75%`").alias("q3"), F.col("o_totalprice_max").alias("mx"))


def gb_ffill_bfill(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    f = events.assign(value=events["value"].where(events["event_id"] % 4 == 0))
    g = f.groupby("user_id")[["value"]]
    return g.ffill().sdf.select("event_id", F.col("value").alias("ff")).join(g.bfill().sdf.select("event_id", F.col("value").alias("bf")), "event_id")


def gb_transform_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupby("o_custkey")["o_totalprice"].transform("max").sdf.select("o_orderkey", F.col("o_totalprice").alias("m"))


def gb_cov_matrix(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    c = customer.groupby("c_mktsegment")[["c_acctbal", "c_nationkey"]].cov()
    return c.sdf.select("c_mktsegment", "variable", *(F.round(x, 4).alias(x) for x in c.columns))


def gb_mapping(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").set_index("n_nationkey", drop=False)
    return nation.groupby({0: "x", 1: "y", 2: "x"}, as_index=False).size().to_spark()


def gb_any_all_prod(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    k = nation["n_nationkey"]
    g = nation.assign(some=k > 20, every=k > 2, p=k + 1).groupby("n_regionkey", as_index=False)
    return g.agg(some=("some", "any"), every=("every", "all"), p=("p", "prod")).to_spark()


def merge_index(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation").set_index("n_nationkey"), table(spark, sf_dir, "region").set_index("r_regionkey")
    return nation.merge(region, left_index=True, right_index=True)[["n_name", "r_name"]].to_spark()


def align_binary(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = Frame(nation.sdf.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v")), ["v"], ["k"], ["k"])
    b = Frame(region.sdf.select(F.col("r_regionkey").alias("k"), F.col("r_regionkey").alias("v")), ["v"], ["k"], ["k"])
    return a.add(b, fill_value=100).to_spark(index=True)


def loc_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part").set_index("p_partkey", drop=False)
    return part.loc[10:20, ["p_partkey", "p_brand"]].to_spark()


def loc_assign(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.loc.set((part["p_size"] > 25, "p_brand"), "large")[["p_partkey", "p_brand"]].to_spark()


def tail_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").tail(7)[["o_orderkey"]].to_spark()


def reset_position(spark, sf_dir):
    f = table(spark, sf_dir, "part").sort_values(["p_size", "p_partkey"], ascending=[False, True], ignore_index=True)
    return f.reset_index()[["index", "p_partkey"]].to_spark()


def rank_average_pct(spark, sf_dir):
    part = table(spark, sf_dir, "part")[["p_size"]]
    got = [part.rank(**how).sdf.select("p_partkey", F.col("p_size").alias(n)) for n, how in (("avg", {}), ("mx", {"method": "max", "ascending": False}), ("pct", {"pct": True}))]
    return got[0].join(got[1], "p_partkey").join(got[2], "p_partkey")


def cum_sum_null(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    v = events.assign(v=events["event_id"].where(events["event_id"] % 3 != 0))[["v"]].cumsum()
    return v.sdf.select("event_id", F.col("v").alias("s"))


def rolling_center_min(spark, sf_dir):
    m = table(spark, sf_dir, "events")["value"].rolling(5, min_periods=1, center=True).min()
    return m.frame.sdf.select("event_id", F.col("__v").alias("m"))


def isin_dict(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    f = Frame(nation.sdf.withColumn("id", F.col("n_nationkey")), nation.columns, ["id"], ["id"])
    return f.isin({"n_regionkey": [1, 2], "n_name": []})[["n_regionkey", "n_name"]].to_spark(index=True)


def dropna_thresh(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    f = events.assign(a=events["value"].where(events["event_id"] % 2 == 0), b=events["value"].where(events["event_id"] % 3 == 0))
    return f.dropna(subset=["a", "b"], thresh=1)[["event_id"]].to_spark()


def unstack_counts(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupby(["o_orderpriority", "o_orderstatus"]).size().to_frame("size")
    u = g.unstack(fill_value=0, labels=["F", "O", "P"])
    return u.to_spark(index=True)


def transpose_small(spark, sf_dir):
    f = table(spark, sf_dir, "region").set_index("r_regionkey", drop=False)[["r_regionkey"]]
    return f.T.to_spark(index=True)


def value_counts_bins(spark, sf_dir):
    return table(spark, sf_dir, "part")["p_size"].value_counts(bins=5).to_spark(index=True)


def agg_list(spark, sf_dir):
    return table(spark, sf_dir, "part")[["p_size", "p_retailprice"]].agg(["min", "max", "count"]).to_spark(index=True)


def to_datetime_unit(spark, sf_dir):
    return table(spark, sf_dir, "nation").sdf.select("n_nationkey", to_datetime(F.col("n_nationkey") * 86400, unit="s").alias("d"))


def date_range_month_end(spark, sf_dir):
    return date_range(spark, "2022-01-15", periods=12, freq="M")


_QUERIES = [
    flagship_clean_group,
    project_select,
    isin_filter,
    isna_notna,
    comp_ops,
    math_ops,
    floordiv_mod,
    abs_pow,
    where_mask,
    fillna_value,
    fillna_ffill,
    fillna_bfill,
    replace_map,
    replace_regex,
    dropna_any,
    astype_cast,
    rename_drop,
    merge_inner,
    merge_left,
    merge_right,
    merge_outer,
    merge_cross,
    merge_indicator,
    merge_select_push,
    group_select_push,
    stats_frame,
    prod_any_all,
    stats_axis1,
    value_counts_norm,
    gb_agg_all,
    gb_multikey,
    gb_moments,
    gb_quantile,
    gb_nunique,
    gb_mad,
    gb_first_last,
    gb_idx,
    gb_head,
    gb_cum,
    gb_shift_diff,
    gb_pct_change,
    gb_rank,
    gb_ngroup,
    gb_filter,
    gb_resample,
    gb_corr_cov,
    rolling_sum,
    cum_ops,
    rank_methods,
    sort_head,
    iloc_slice,
    duplicated_flag,
    drop_duplicates_first,
    concat_axis0,
    concat_axis1,
    pivot_table,
    pivot_margins,
    stack_unpivot,
    explode_list,
    to_datetime_parse,
    date_range_daily,
    applymap_native,
    reindex_labels,
    combine_min,
    gb_sample,
    gb_apply_udf,
    apply_axis1_udf,
    channel_shards,
    memory_usage,
    gb_first_nth_tail,
    gb_describe,
    gb_ffill_bfill,
    gb_transform_max,
    gb_cov_matrix,
    gb_mapping,
    gb_any_all_prod,
    merge_index,
    align_binary,
    loc_labels,
    loc_assign,
    tail_rows,
    reset_position,
    rank_average_pct,
    cum_sum_null,
    rolling_center_min,
    isin_dict,
    dropna_thresh,
    unstack_counts,
    transpose_small,
    value_counts_bins,
    agg_list,
    to_datetime_unit,
    date_range_month_end,
]


def queries():
    from . import queries_api

    return {f.__name__: f for f in _QUERIES} | queries_api.queries()


SQL = {
    "gb_sample": "SELECT o_orderstatus, least(3, count(*)) AS size FROM orders GROUP BY 1",
    "value_counts_bins": "SELECT least(floor((p_size - lo) / w), 4) * w + lo AS value, count(*) AS count FROM part, (SELECT min(p_size) AS lo, (max(p_size) - min(p_size)) / 5 AS w FROM part) GROUP BY 1",
    "memory_usage": "SELECT 'n_name' AS \"column\", sum(strlen(n_name))::BIGINT AS bytes FROM nation UNION ALL SELECT 'n_nationkey', 4 * count(*) FROM nation UNION ALL SELECT 'n_regionkey', 4 * count(*) FROM nation",
    "flagship_clean_group": "SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag='R' GROUP BY 1",
    "project_select": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity <= 6",
    "isin_filter": "SELECT o_orderkey, o_orderpriority IN ('1-URGENT','2-HIGH') AS hot FROM orders",
    "isna_notna": "SELECT event_id, value IS NULL AS is_na, value IS NOT NULL AS not_na FROM events",
    "comp_ops": "SELECT o_orderkey, coalesce(o_totalprice > 1000, false) AS gt, coalesce(o_totalprice <= 1000, false) AS le, coalesce(o_orderstatus = 'F', false) AS eq, coalesce(o_orderstatus <> 'F', true) AS ne FROM orders",
    "math_ops": "SELECT o_orderkey, o_totalprice + 1 AS a, o_totalprice - 1 AS s, o_totalprice * 2 AS m, o_totalprice / 2 AS d FROM orders",
    "floordiv_mod": "SELECT c_custkey, floor(c_acctbal/7) AS fd, c_acctbal - 7*floor(c_acctbal/7) AS md FROM customer",
    "abs_pow": "SELECT c_custkey, abs(c_acctbal) AS a, pow(c_nationkey, 2) AS p FROM customer",
    "where_mask": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS w, CASE WHEN c_acctbal > 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS m FROM customer",
    "fillna_value": "SELECT event_id, coalesce(value, -1.0) AS v FROM events",
    "fillna_ffill": "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events",
    "fillna_bfill": "SELECT event_id, first_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM events",
    "replace_map": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS s FROM orders",
    "replace_regex": "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') AS n FROM part",
    "dropna_any": "SELECT event_id, value FROM events WHERE value IS NOT NULL",
    "astype_cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey AS INTEGER) AS i FROM orders",
    "rename_drop": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "merge_inner": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey=o_custkey",
    "merge_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey=o_custkey",
    "merge_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey=o_custkey",
    "merge_outer": "SELECT coalesce(s_nationkey,n_nationkey) AS k, s_suppkey, n_name FROM supplier FULL JOIN nation ON s_nationkey=n_nationkey",
    "merge_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "merge_indicator": "SELECT n_nationkey, CASE WHEN s_nationkey IS NULL THEN 'left_only' ELSE 'both' END AS m FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON n_nationkey=s_nationkey",
    "merge_select_push": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey >= 10",
    "group_select_push": "SELECT * FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) WHERE c_nationkey < 4",
    "stats_frame": "SELECT max(l_quantity) AS mx, min(l_quantity) AS mn, count(l_quantity) AS n, round(avg(l_quantity),6) AS mean, median(l_quantity) AS med, round(stddev_samp(l_quantity),6) AS sd, round(var_samp(l_quantity),6) AS vr FROM lineitem",
    "prod_any_all": "SELECT product(1 + r_regionkey) AS p, bool_or(r_regionkey > 3) AS a, bool_and(r_regionkey >= 0) AS b FROM region",
    "stats_axis1": "SELECT l_orderkey, l_linenumber, l_quantity + l_tax + l_discount AS s, greatest(l_quantity, l_tax) AS g FROM lineitem",
    "value_counts_norm": "SELECT o_orderpriority, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS f FROM orders GROUP BY 1",
    "gb_agg_all": "SELECT l_returnflag, round(sum(l_tax), 4) AS s, count(l_tax) AS c, count(*) AS n, min(l_tax) AS mn, max(l_tax) AS mx FROM lineitem GROUP BY 1",
    "gb_multikey": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1,2",
    "gb_moments": "SELECT o_orderstatus, round(stddev_samp(o_totalprice),4) AS sd, round(stddev_samp(o_totalprice)/sqrt(count(*)),4) AS se, round(skewness(o_totalprice),4) AS sk FROM orders GROUP BY 1",
    "gb_quantile": "SELECT o_orderstatus, median(o_totalprice) AS md, quantile_cont(o_totalprice, 0.25) AS q FROM orders GROUP BY 1",
    "gb_nunique": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1",
    "gb_mad": "SELECT o_orderstatus, round(avg(abs(o_totalprice - m)),4) AS mad FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m FROM orders) GROUP BY 1",
    "gb_first_last": "SELECT user_id, arg_min(value, event_id) AS o, max(value) AS h, min(value) AS l, arg_max(value, event_id) AS c FROM events GROUP BY 1",
    "gb_idx": "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS imax FROM orders GROUP BY 1",
    "gb_head": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2",
    "gb_cum": "SELECT event_id, row_number() OVER w - 1 AS cc, max(value) OVER w AS cm FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
    "gb_shift_diff": "SELECT event_id, lag(value) OVER w AS s, value - lag(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "gb_pct_change": "SELECT event_id, CASE WHEN lag(value) OVER w <> 0 THEN value / lag(value) OVER w - 1 END AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "gb_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1)/2.0::DOUBLE AS r FROM orders",
    "gb_ngroup": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS g FROM orders",
    "gb_filter": "SELECT o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 10",
    "gb_resample": "SELECT user_id, date_trunc('day', ts) AS d, count(event_id) AS n FROM events GROUP BY 1, 2",
    "gb_corr_cov": "SELECT l_returnflag, round(corr(l_quantity,l_extendedprice),6) AS r, round(covar_samp(l_quantity,l_tax),6) AS cv FROM lineitem GROUP BY 1",
    "rolling_sum": "SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN max(value) OVER w END AS m FROM events WINDOW w AS (ORDER BY event_id ROWS 2 PRECEDING)",
    "cum_ops": "SELECT o_orderkey, sum(o_custkey) OVER w ::BIGINT AS cs, max(o_totalprice) OVER w AS cx, min(o_totalprice) OVER w AS cn FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)",
    "rank_methods": "SELECT p_partkey, rank() OVER (ORDER BY p_size) AS mn, dense_rank() OVER (ORDER BY p_size) AS ds, row_number() OVER (ORDER BY p_size, p_partkey) AS f FROM part",
    "sort_head": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "iloc_slice": "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) BETWEEN 11 AND 20",
    "duplicated_flag": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS dup FROM orders",
    "drop_duplicates_first": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "concat_axis0": "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
    "concat_axis1": "SELECT coalesce(n_nationkey, r_regionkey) AS k, n_name, r_name FROM nation FULL JOIN region ON n_nationkey=r_regionkey",
    "pivot_table": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o, count(*) FILTER (o_orderstatus='P') AS p FROM orders GROUP BY 1",
    "pivot_margins": "SELECT coalesce(o_orderstatus,'All') AS s, coalesce(o_orderpriority,'All') AS p, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "stack_unpivot": "SELECT n_nationkey, 'n_regionkey' AS var, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'n_nationkey', n_nationkey FROM nation",
    "explode_list": "SELECT vec_id, unnest(embedding) AS x FROM embeddings",
    "to_datetime_parse": "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS d FROM orders",
    "date_range_daily": "SELECT unnest(generate_series(TIMESTAMP '2022-01-01', TIMESTAMP '2022-01-31', INTERVAL 1 DAY)) AS d",
    "applymap_native": "SELECT p_partkey, upper(p_brand) AS b, length(p_name) AS n FROM part",
    "reindex_labels": "SELECT l.k, coalesce(n_name,'none') AS n_name FROM (SELECT CAST(unnest(range(20,30)) AS INTEGER) AS k) l LEFT JOIN nation ON k=n_nationkey",
    "combine_min": "SELECT coalesce(a.n_nationkey,b.r_regionkey) AS k, least(a.n_regionkey, b.r_regionkey) AS v FROM nation a FULL JOIN region b ON a.n_nationkey=b.r_regionkey",
    "channel_shards": "SELECT CAST(n_nationkey // 5 AS INTEGER) AS shard, count(*) AS n, min(n_nationkey) AS lo, max(n_nationkey) AS hi FROM nation GROUP BY 1",
    "apply_axis1_udf": "SELECT r_regionkey, length(r_name) + r_regionkey AS v FROM region",
    "gb_apply_udf": "SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1",
    "gb_first_nth_tail": "SELECT a.o_custkey, second, last FROM (SELECT o_custkey, o_orderkey AS second FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 2) a JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1) b USING (o_custkey)",
    "gb_describe": "SELECT o_orderstatus, count(o_totalprice) AS n, min(o_totalprice) AS mn, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS md, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS mx FROM orders GROUP BY 1",
    "gb_ffill_bfill": "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ff, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events)",
    "gb_transform_max": "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders",
    "gb_cov_matrix": "WITH g AS (SELECT c_mktsegment, var_samp(c_acctbal) AS aa, covar_samp(c_acctbal, c_nationkey) AS an, var_samp(c_nationkey) AS nn FROM customer GROUP BY 1) SELECT c_mktsegment, 'c_acctbal' AS variable, round(aa, 4) AS c_acctbal, round(an, 4) AS c_nationkey FROM g UNION ALL SELECT c_mktsegment, 'c_nationkey', round(an, 4), round(nn, 4) FROM g",
    "gb_mapping": "SELECT CASE WHEN n_nationkey = 1 THEN 'y' ELSE 'x' END AS key, count(*) AS size FROM nation WHERE n_nationkey IN (0, 1, 2) GROUP BY 1",
    "gb_any_all_prod": "SELECT n_regionkey, bool_or(n_nationkey > 20) AS some, bool_and(n_nationkey > 2) AS every, product(n_nationkey + 1) AS p FROM nation GROUP BY 1",
    "merge_index": "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey = r_regionkey",
    "align_binary": "SELECT coalesce(n_nationkey, r_regionkey) AS k, coalesce(n_regionkey, 100) + coalesce(r_regionkey, 100) AS v FROM nation FULL JOIN region ON n_nationkey = r_regionkey",
    "loc_labels": "SELECT p_partkey, p_brand FROM part WHERE p_partkey BETWEEN 10 AND 20",
    "loc_assign": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE p_brand END AS p_brand FROM part",
    "tail_rows": "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7",
    "reset_position": "SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS index, p_partkey FROM part",
    "rank_average_pct": "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS avg, rank() OVER (ORDER BY p_size DESC) + count(*) OVER (PARTITION BY p_size) - 1 AS mx, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM part",
    "cum_sum_null": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(sum(CASE WHEN event_id % 3 <> 0 THEN event_id END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS s FROM events",
    "rolling_center_min": "SELECT event_id, min(value) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM events",
    "isin_dict": "SELECT n_nationkey AS id, n_regionkey IN (1, 2) AS n_regionkey, false AS n_name FROM nation",
    "dropna_thresh": "SELECT event_id FROM events WHERE value IS NOT NULL AND (event_id % 2 = 0 OR event_id % 3 = 0)",
    "unstack_counts": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "transpose_small": "SELECT 'r_regionkey' AS key, 0 AS \"0\", 1 AS \"1\", 2 AS \"2\", 3 AS \"3\", 4 AS \"4\"",
    "agg_list": "SELECT 'min' AS func, min(p_size)::DOUBLE AS p_size, min(p_retailprice) AS p_retailprice FROM part UNION ALL SELECT 'max', max(p_size), max(p_retailprice) FROM part UNION ALL SELECT 'count', count(p_size), count(p_retailprice) FROM part",
    "to_datetime_unit": "SELECT n_nationkey, TIMESTAMP '1970-01-01' + to_days(n_nationkey) AS d FROM nation",
    "date_range_month_end": "SELECT CAST(last_day(unnest(generate_series(DATE '2022-01-15', DATE '2022-12-15', INTERVAL 1 MONTH))::DATE) AS TIMESTAMP) AS d",
}


def oracle_sql():
    from . import queries_api

    return SQL | queries_api.oracle_sql()
