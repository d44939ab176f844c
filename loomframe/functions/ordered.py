"""Whole-frame ordered operators without a single-task window.

A frame is range-partitioned by its order and stored once, with the number of its range.  What a row needs from the
ranges before its own is one row of partial results a range, carried in by a broadcast join whose size is the number of
partitions; what it needs from close by comes from blocks of positions that overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import store

PART = "__part"


def _order(order, descending: bool = False):
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order]


def ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` with the number of its range by ``order`` (names or sort expressions)."""
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    return store(df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()), "ranged")


def _before(sums: DataFrame, names: dict[str, str], by: list[str] = ()) -> DataFrame:
    """For each range, and group ``by``, the sum, least, greatest or last of ``names`` over the ranges before it; a row a row of ``sums``."""
    w = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    how = {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product, "last": lambda c: F.last(c, ignorenulls=True)}
    return sums.select(PART, *by, *(how[h](n).over(w).alias(f"__in_{n}") for n, h in names.items()))


def with_position(df: DataFrame, order: list[str], name: str = "__pos") -> DataFrame:
    """A dense position from 0 in ``order``."""
    r = ranged(df, order)
    offsets = _before(r.groupBy(PART).agg(F.count("*").alias("n")), {"n": "sum"})
    at = F.row_number().over(Window.partitionBy(PART).orderBy(*_order(order)))
    return r.withColumn(name, at.cast("long")).join(F.broadcast(offsets), PART).withColumn(name, F.col(name) - 1 + F.coalesce("__in_n", F.lit(0))).drop(PART, "__in_n")


def running(df: DataFrame, order: list[str], jobs: dict[str, tuple[str, str]], by: list[str] = ()) -> DataFrame:
    """Columns ``{new: (how, column)}``, how being sum, min, max, prod or last (non-null), over all rows up to each.

    A running result of a null value is NULL, but for last, which is what forward filling needs.  With ``by`` each of
    its groups runs for itself; a group may span any number of ranges, and of a range only its first and last
    group, at most two rows, are carried.
    """
    r = ranged(df, [*by, *order])
    partial = {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product}
    w = Window.partitionBy(PART, *by).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(*order)
    sums = r.groupBy(PART, *by).agg(*((F.max_by(c, F.when(F.col(c).isNotNull(), key)) if how == "last" else partial[how](c)).alias(n) for n, (how, c) in jobs.items()))
    if by:
        place = F.struct(*(x for k in by for x in (F.col(k).isNull(), F.col(k))))
        ends = Window.partitionBy(PART)
        sums = sums.withColumns({"__lo": F.min(place).over(ends), "__hi": F.max(place).over(ends)}).where((place == F.col("__lo")) | (place == F.col("__hi"))).drop("__lo", "__hi")
    carried = _before(sums, {n: how for n, (how, _) in jobs.items()}, by)
    if by:
        carried = carried.select(F.col(PART).alias("__p"), *(F.col(k).alias(f"__by_{k}") for k in by), *(f"__in_{n}" for n in jobs))
        out = r.join(F.broadcast(carried), [r[PART] == F.col("__p"), *(r[k].eqNullSafe(F.col(f"__by_{k}")) for k in by)], "left").drop("__p", *(f"__by_{k}" for k in by))
    else:
        out = r.join(F.broadcast(carried), PART)
    new = {}
    for n, (how, c) in jobs.items():
        up = F.col(f"__in_{n}")
        if how == "last":
            new[n] = F.coalesce(F.last(c, ignorenulls=True).over(w), up)
        else:
            here = partial[how](c).over(w)
            both = {"sum": here + F.coalesce(up, F.lit(0)), "prod": here * F.coalesce(up, F.lit(1.0)), "min": F.least(here, up), "max": F.greatest(here, up)}[how]
            new[n] = F.when(F.col(c).isNotNull(), both)
    return out.withColumns(new).drop(PART, *(f"__in_{n}" for n in jobs))


def ranked(df: DataFrame, col: str, names: dict[str, str], ascending: bool = True, ties: list[str] = (), na_option: str = "keep", pct: bool = False, by: list[str] = ()) -> DataFrame:
    """Ranks ``{new: method}`` of ``col`` over the whole frame, or within the groups of ``by``.

    Values are counted first and the different ones ranked, so that neither a hot value nor a hot group is gathered;
    the ranks come back by a join.  Method ``first`` numbers the rows themselves, in the order of ``ties``.
    """
    if unknown := set(names.values()) - {"average", "min", "max", "dense", "first"}:
        raise ValueError(f"unknown method {unknown}")
    v, null = F.col(col), F.col(col).isNull()
    # places for the running counts: by null first or last, then by value, downwards by a second sort key
    at_null = F.when(null, -1 if na_option == "top" else 1).otherwise(0)
    seen = df if na_option != "keep" else df.where(~null)
    groups = [f"__b{n}" for n in range(len(by))]
    counts = seen.groupBy(*(F.col(k).alias(g) for k, g in zip(by, groups, strict=True)), v.alias("__v")).agg(F.count("*").alias("__c"))
    counts = counts.withColumns({"__z": F.when(F.col("__v").isNull(), -1 if na_option == "top" else 1).otherwise(0), "__one": F.lit(1)})
    run = running(counts, ["__z", "__v"], {"__n": ("sum", "__c"), "__d": ("sum", "__one")}, groups)
    if not ascending or pct:
        run = store(run, "counts")
        whole = [g + "_" for g in groups]
        total = run.groupBy(*(F.col(g).alias(h) for g, h in zip(groups, whole, strict=True))).agg(F.sum("__c").alias("__tn"), F.count("*").alias("__td"), F.sum(F.when(F.col("__z") == 0, F.col("__c"))).alias("__tn0"), F.count(F.when(F.col("__z") == 0, 1)).alias("__td0"))
        run = run.join(total, [F.col(g).eqNullSafe(F.col(h)) for g, h in zip(groups, whole, strict=True)]) if by else run.crossJoin(F.broadcast(total))  # one row without groups
        run = run.drop(*whole)
    low, dense = F.col("__n") - F.col("__c"), F.col("__d") - 1  # rows and values ahead
    if not ascending:
        ahead_n, ahead_d = (F.coalesce(F.col("__tn") - F.col("__tn0"), F.lit(0)), F.col("__td") - F.col("__td0")) if na_option == "top" else (F.lit(0), F.lit(0))
        base_n, base_d = (ahead_n, ahead_d) if na_option == "top" else (F.lit(0), F.lit(0))
        low = F.when(F.col("__z") == 0, base_n + F.col("__tn0") - (F.col("__n") - base_n)).otherwise(low)
        dense = F.when(F.col("__z") == 0, base_d + F.col("__td0") - (F.col("__d") - base_d)).otherwise(dense)
    same = F.col("__c")
    got = {"min": low + 1, "max": low + same, "average": low + (same + 1) / 2.0, "dense": dense + 1, "first": low + 1}
    cols = {}
    for n, method in names.items():
        e = got[method].cast("double" if method == "average" else "long")
        cols[n] = e / F.col("__td" if method == "dense" else "__tn") if pct and method != "first" else e
    if pct and "first" in names.values():
        cols["__tn"] = F.col("__tn")
    ranks = run.select(*groups, "__v", *(e.alias(n) for n, e in cols.items()))
    if "first" in names.values():  # rows of equal values in their order, group by group
        df = running(df.withColumns({"__one": F.lit(1), "__zz": at_null}), list(ties), {"__nth": ("sum", "__one")}, [*by, "__zz", col]).drop("__one", "__zz")
    out = df.join(ranks, [*(df[k].eqNullSafe(ranks[g]) for k, g in zip(by, groups, strict=True)), df[col].eqNullSafe(ranks["__v"])], "left").drop("__v", *groups)
    for n, method in names.items():
        if method == "first":
            e = F.col(n) + F.col("__nth") - 1
            out = out.withColumn(n, e / F.col("__tn") if pct else e)
    return out.drop("__nth", "__tn")


def halo(df: DataFrame, order: list[str], before: int, after: int, block: int = 4096) -> DataFrame:
    """``df`` with ``__pos``, ``__block`` and ``__own``: blocks of positions, with ``before`` rows ahead of and ``after`` rows behind each block.

    Windows over (``__block``, ``__pos``) see the neighbours they need; rows with ``__own`` are the result.
    """
    block = max(block, 4 * (before + after))
    p = with_position(df, order)
    b = F.floor(F.col("__pos") / block)
    ahead = F.when(F.col("__pos") % block >= block - before, b + 1) if before else F.lit(None).cast("long")
    behind = F.when(F.col("__pos") % block < after, b - 1) if after else F.lit(None).cast("long")
    p = p.withColumn("__block", F.explode(F.array_compact(F.array(b, ahead, behind))))
    return p.withColumn("__own", F.col("__block") == b)


def moving(df: DataFrame, order: list[str], new: dict[str, Column], before: int = 0, after: int = 0, by: list[str] = ()) -> DataFrame:
    """Columns ``{new: f(window)}`` where f takes a window over neighbouring rows, of the same group ``by``, and gives a column."""
    h = halo(df, [*by, *order], before, after)
    w = Window.partitionBy("__block", *by).orderBy("__pos")
    h = h.withColumns({n: f(w) for n, f in new.items()})
    return h.where("__own").drop("__pos", "__block", "__own")
