"""Grouped aggregates, transforms and selections."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered, scalars
from ..functions.datetimes import interval
from .frame import Frame, Series, _native, _vector, spark_type


class Grouper:
    """A time bucket of a column, or a plain key."""

    def __init__(self, key: str, freq: str | None = None):
        self.key, self.freq = key, freq

    def expr(self) -> Column:
        if self.freq is None:
            return F.col(self.key)
        n, unit = interval(self.freq)
        if n == 1:
            return F.date_trunc(unit.lower(), self.key).cast("timestamp_ntz")
        return F.window(F.col(self.key).cast("timestamp"), f"{n} {unit.lower()}")["start"].cast("timestamp_ntz")


class GroupBy:
    def __init__(self, frame: Frame, by=None, level=None, as_index=True, sort=True, dropna=True):
        if by is None and level is None:
            raise TypeError("by or level must be given")
        if level is not None:
            levels = level if isinstance(level, (list, tuple)) else [level]
            frame = frame.labelled()
            by = [frame.index[x] if isinstance(x, int) else x for x in levels]
        many = list(by) if isinstance(by, (list, tuple)) and not isinstance(by, str) else [by]
        keys: dict[str, Column] = {}
        mapped = False
        for n, b in enumerate(many):
            if isinstance(b, str):
                if b not in frame.columns + frame.index:
                    raise KeyError(b)
                keys[b] = F.col(b)
            elif isinstance(b, Series):
                if b.frame.sdf is not frame.sdf:
                    frame = frame.assign(**{f"__by{n}": b})
                    keys[b.name or f"key_{n}"] = F.col(f"__by{n}")
                    frame = frame._new(frame.sdf, columns=[c for c in frame.columns if c != f"__by{n}"])
                else:
                    keys[b.name or f"key_{n}"] = b.expr
            elif isinstance(b, Grouper):
                keys[b.key] = b.expr()
            elif isinstance(b, dict):
                frame, mapped = frame.labelled(), True
                m = F.create_map(*(F.lit(x) for kv in b.items() for x in kv))
                keys["key"] = m[F.col(frame.index[0])]
            elif isinstance(b, Column):
                keys[f"key_{n}"] = b
            elif callable(b):  # of the labels
                frame, mapped = frame.labelled(), True
                keys["key"] = _labels(b, frame)
            else:
                raise TypeError(f"can't group by {type(b).__name__}")
        # keys get names of their own, so that transforms may replace the columns that they come from
        self.keys = list(keys)
        self._k = [f"__g{n}" for n in range(len(keys))]
        sdf = frame.sdf.withColumns(dict(zip(self._k, keys.values(), strict=True)))
        if dropna:
            for k in self._k:
                sdf = sdf.where(F.col(k).isNotNull())
        self.frame = Frame(sdf, frame.columns, frame.index, frame.order)
        self.columns = [c for c in frame.columns if c not in keys or mapped]
        self.as_index, self.sort, self.dropna = as_index, sort, dropna

    ndim = 2

    def __getitem__(self, cols) -> GroupBy:
        out = object.__new__(GroupBy)
        out.__dict__ = dict(self.__dict__)
        out.columns = [cols] if isinstance(cols, str) else list(cols)
        missing = [c for c in out.columns if c not in self.frame.columns]
        if missing:
            raise KeyError(missing)
        return out

    # -- access
    def _result(self, aggs: list[Column]) -> Frame:
        sdf = self.frame.sdf.groupBy(*self._k).agg(*aggs)
        sdf = sdf.withColumnsRenamed(dict(zip(self._k, self.keys, strict=True)))
        data = [c for c in sdf.columns if c not in self.keys]
        return Frame(sdf, data if self.as_index else self.keys + data, self.keys if self.as_index else [], self.keys if self.sort else [])

    ngroups = property(lambda self: self.frame.sdf.select(*self._k).distinct().count())
    __len__ = lambda self: self.ngroups

    def _members(self, what: Column) -> dict:
        rows = self.frame.sdf.groupBy(*self._k).agg(F.array_sort(F.collect_list(what)).alias("m")).collect()
        return {(r[0] if len(self._k) == 1 else tuple(r[:-1])): [x[-1] for x in r["m"]] for r in rows}

    @property
    def groups(self) -> dict:
        """key -> labels; for small frames."""
        g = self._labelled()
        return g._members(F.struct(*g.frame.order, F.col(g.frame.index[0]).alias("__l")))

    @property
    def indices(self) -> dict:
        """key -> positions; for small frames."""
        g = self._labelled()
        pos = ordered.with_position(g.frame.sdf, g.frame.order)
        g.frame = Frame(pos, g.frame.columns, g.frame.index, g.frame.order)
        return g._members(F.struct(F.col("__pos")))

    def get_group(self, key) -> Frame:
        want = key if isinstance(key, tuple) else (key,)
        cond = F.lit(True)
        for k, v in zip(self._k, want, strict=True):
            cond = cond & F.col(k).eqNullSafe(F.lit(v))
        return self.frame.filter(cond)

    def __iter__(self):
        rows = self.frame.sdf.select(*self._k).distinct().orderBy(*self._k).toLocalIterator()
        for r in rows:
            yield (r[0] if len(self._k) == 1 else tuple(r)), self.get_group(tuple(r))

    def _ordered(self) -> GroupBy:
        out = self[self.columns]
        out.frame = self.frame.ordered()
        return out

    def _labelled(self) -> GroupBy:
        out = self[self.columns]
        out.frame = self.frame.labelled()
        return out

    # -- aggregates
    def _numeric(self) -> list[str]:
        return [c for c in self.columns if c in self.frame.numeric()]

    def _named(self, how: str, **k) -> Frame:
        cols = self._numeric() if how in scalars.NUMERIC_ONLY or how == "sum" else self.columns
        return self._result([self._one(how, c, **k).alias(c) for c in cols])

    def _one(self, how: str, c: str, ddof=1, min_count=0, **_) -> Column:
        if how == "first" or how == "last":
            return self._end(how, c)
        if how == "mad":
            raise ValueError("mad has no single pass; call mad()")
        return Frame._agg(how, self.frame.col(c), ddof, max(min_count, 0))

    def size(self):
        out = self._result([F.count(F.lit(1)).alias("size")])
        return out if not self.as_index else Series(out, F.col("size"), "size")

    def agg(self, arg=None, **named) -> Frame:
        """Names, a list of names, a dict of columns, or named=(column, name)."""
        if isinstance(arg, str):
            return self.size() if arg == "size" else getattr(self, arg)()
        g = self._ordered() if "first" in str(arg) + str(named) or "last" in str(arg) + str(named) else self
        if named:
            return g._result([g._one(f, c).alias(n) for n, (c, f) in named.items()])
        jobs = arg if isinstance(arg, dict) else {c: arg for c in self.columns}
        aggs = []
        for c, fs in jobs.items():
            for f in [fs] if isinstance(fs, (str,)) or callable(fs) else fs:
                e = f(self.frame.col(c)) if callable(f) else g._one(f, c)
                aggs.append(e.alias(c if isinstance(fs, str) or callable(fs) else f"{c}_{f}"))
        return g._result(aggs)

    aggregate = agg

    def _end(self, how: str, c: str) -> Column:
        e = self.frame.col(c)
        at = F.when(e.isNotNull(), F.struct(*self.frame.order))
        return (F.min_by if how == "first" else F.max_by)(e, at)

    def first(self):
        g = self._ordered()
        return g._result([g._end("first", c).alias(c) for c in g.columns])

    def last(self):
        g = self._ordered()
        return g._result([g._end("last", c).alias(c) for c in g.columns])

    def ohlc(self):
        g = self._ordered()
        out = []
        for c in g._numeric():
            p = "" if len(g._numeric()) == 1 else f"{c}_"
            out += [g._end("first", c).alias(f"{p}open"), F.max(g.frame.col(c)).alias(f"{p}high"), F.min(g.frame.col(c)).alias(f"{p}low"), g._end("last", c).alias(f"{p}close")]
        return g._result(out)

    def quantile(self, q=0.5):
        """A quantile of each column; of a list of them each, as ``column_q``, in one pass."""
        many = q if isinstance(q, (list, tuple)) else [q]
        return self._result([F.percentile(self.frame.col(c), p).alias(c if many is not q else f"{c}_{p}") for c in self._numeric() for p in many])

    def describe(self):
        out = []
        for c in self._numeric():
            e = self.frame.col(c)
            out += [F.count(e).alias(f"{c}_count"), F.avg(e).alias(f"{c}_mean"), F.stddev_samp(e).alias(f"{c}_std"), F.min(e).alias(f"{c}_min")]
            out += [F.percentile(e, p / 100).alias(f"{c}_{p}%") for p in (25, 50, 75)] + [F.max(e).alias(f"{c}_max")]
        return self._result(out)

    def mad(self):
        """Mean absolute deviation from the group's mean, in two aggregates."""
        cols = self._numeric()
        means = self.frame.sdf.groupBy(*(F.col(k).alias(f"{k}_") for k in self._k)).agg(*(F.avg(self.frame.col(c)).alias(f"__m_{c}") for c in cols))
        cond = [self.frame.sdf[k].eqNullSafe(means[f"{k}_"]) for k in self._k]
        g = self[cols]
        g.frame = Frame(self.frame.sdf.join(means, cond).drop(*(f"{k}_" for k in self._k)), self.frame.columns, self.frame.index, self.frame.order)
        return g._result([F.avg(F.abs(F.col(c) - F.col(f"__m_{c}"))).alias(c) for c in cols])

    def idxmax(self):
        return self._idx(F.max_by, -1)

    def idxmin(self):
        return self._idx(F.min_by, 1)

    def _idx(self, pick, sign):
        """The label of the extreme; of ties the first row's."""
        g = self._labelled()
        pos = g.frame
        if pos.order != ["__idx"]:
            pos = Frame(ordered.with_position(pos.sdf, pos.order), pos.columns, pos.index, ["__pos"])
        g.frame = pos
        at = F.col(pos.order[0]) * sign
        return g._result([pick(F.col(pos.index[0]), F.when(pos.col(c).isNotNull(), F.struct(pos.col(c), at))).alias(c) for c in g._numeric()])

    def _pairs(self, f) -> Frame:
        cols = self._numeric()
        aggs = [f(self.frame.col(a), self.frame.col(b)).alias(f"{a}\n{b}") for a, b in [*combinations(cols, 2), *((c, c) for c in cols)]]
        wide = self.frame.sdf.groupBy(*self._k).agg(*aggs).withColumnsRenamed(dict(zip(self._k, self.keys, strict=True)))
        have = set(wide.columns)
        cell = lambda a, b: F.col(f"`{a}\n{b}`" if f"{a}\n{b}" in have else f"`{b}\n{a}`")
        rows = F.array(*(F.struct(F.lit(n).alias("__at"), F.lit(a).alias("variable"), *(cell(a, b).alias(b) for b in cols)) for n, a in enumerate(cols)))
        sdf = wide.select(*self.keys, F.inline(rows))
        return Frame(sdf, cols, [*self.keys, "variable"], [*self.keys, "__at"])

    def corr(self):
        return self._pairs(F.corr)

    def cov(self):
        return self._pairs(F.covar_samp)

    def corrwith(self, other: Frame):
        cols = [c for c in self._numeric() if c in other.columns]
        a, b = self.frame.labelled(), other.labelled()
        right = b.sdf.select(*(F.col(i).alias(f"__j{n}") for n, i in enumerate(b.index)), *(b.col(c).alias(f"__o_{c}") for c in cols))
        g = self[cols]
        g.frame = Frame(a.sdf.join(right, [a.sdf[i].eqNullSafe(right[f"__j{n}"]) for n, i in enumerate(a.index)]), a.columns, a.index, a.order)
        return g._result([F.corr(g.frame.col(c), F.col(f"__o_{c}")).alias(c) for c in cols])

    # -- transforms: ranges of (key, order), so that a hot group is many tasks'
    def _window(self, descending=False):
        return Window.partitionBy(*self._k).orderBy(*ordered._order(self.frame.order, descending))

    def _transform(self, make, cols=None, numeric=True) -> Frame:
        """``make(frame's Spark frame with cleaned columns __c_*, order, cols)`` adds the columns ``__t_*`` that replace ``cols``."""
        g = self._ordered()
        cols = cols or (g._numeric() if numeric else g.columns)
        clash = [c for c in cols if c in g.frame.order]
        src = g.frame.sdf.select(*dict.fromkeys([*g.frame._keep(), *g._k])).withColumns({f"__c_{c}": g.frame.col(c) for c in cols})
        sdf = make(src, g.frame.order, cols).drop(*(f"__c_{c}" for c in cols))
        order = g.frame.order
        if clash:
            sdf = sdf.withColumns({f"__o_{c}": F.col(c) for c in clash})
            order = [f"__o_{c}" if c in clash else c for c in order]
        return Frame(sdf.withColumns({c: F.col(f"__t_{c}") for c in cols}).drop(*(f"__t_{c}" for c in cols)), cols, g.frame.index, order)

    def _running(self, how: str) -> Frame:
        return self._transform(lambda src, order, cols: ordered.running(src, order, {f"__t_{c}": (how, f"__c_{c}") for c in cols}, self._k))

    def _moving(self, f, before: int, after: int, numeric=True) -> Frame:
        return self._transform(lambda src, order, cols: ordered.moving(src, order, {f"__t_{c}": (lambda w, c=c: f(F.col(f"__c_{c}"), w)) for c in cols}, before, after, self._k), numeric=numeric)

    def cumsum(self):
        return self._running("sum")

    def cumprod(self):
        return self._running("prod")

    def cummin(self):
        return self._running("min")

    def cummax(self):
        return self._running("max")

    def cumcount(self, ascending=True) -> Series:
        g = self._ordered()
        src = g.frame.sdf.withColumn("__one", F.lit(1))
        f = ordered.running(src, g.frame.order, {"cumcount": ("sum", "__one")}, g._k).drop("__one")
        if ascending:
            f = f.withColumn("cumcount", F.col("cumcount").cast("long") - 1)
        else:
            n = g.frame.sdf.groupBy(*(F.col(k).alias(f"{k}_") for k in g._k)).agg(F.count("*").alias("__n"))
            f = f.join(n, [f[k].eqNullSafe(n[f"{k}_"]) for k in g._k]).withColumn("cumcount", F.col("__n") - F.col("cumcount")).drop("__n", *(f"{k}_" for k in g._k))
        return Series(Frame(f, ["cumcount"], g.frame.index, g.frame.order), F.col("cumcount"), "cumcount")

    def ngroup(self, ascending=True) -> Series:
        """Numbers of the groups in key order: ranked among the distinct keys, then joined."""
        g = self._ordered()
        distinct = g.frame.sdf.select(*(F.col(k).alias(f"{k}_") for k in self._k)).distinct()
        num = ordered.with_position(distinct, [f"{k}_" for k in self._k], "ngroup")
        if not ascending:
            num = num.withColumn("ngroup", F.lit(num.count() - 1) - F.col("ngroup"))
        f = g.frame.sdf.join(num, [g.frame.sdf[k].eqNullSafe(num[f"{k}_"]) for k in self._k]).drop(*(f"{k}_" for k in self._k))
        return Series(Frame(f, ["ngroup"], g.frame.index, g.frame.order), F.col("ngroup"), "ngroup")

    def rank(self, method="average", ascending=True, na_option="keep", pct=False):
        def make(src, order, cols):
            for c in cols:
                src = ordered.ranked(src, f"__c_{c}", {f"__t_{c}": method}, ascending, order, na_option, pct, self._k)
            return src

        return self._transform(make)

    def shift(self, periods=1, fill_value=None):
        if periods >= 0:
            return self._moving(lambda c, w: F.lag(c, periods, fill_value).over(w), periods, 0, numeric=False)
        return self._moving(lambda c, w: F.lead(c, -periods, fill_value).over(w), 0, -periods, numeric=False)

    def tshift(self, periods=1, freq="D", on=None):
        """The time column, or index, moved by ``periods`` of ``freq``."""
        n, unit = interval(freq)
        c = on or self.frame.index[0]
        step = F.expr(f"INTERVAL '{n * periods}' {unit}")
        return self.frame._new(self.frame.sdf.withColumn(c, F.col(c) + step))

    @staticmethod
    def _back(c, w, periods: int):
        return F.lag(c, periods).over(w) if periods >= 0 else F.lead(c, -periods).over(w)

    def diff(self, periods=1):
        return self._moving(lambda c, w: c - self._back(c, w, periods), max(0, periods), max(0, -periods))

    def pct_change(self, periods=1):
        h = self[self._numeric()]
        h.frame = h.ffill()
        return h._moving(lambda c, w: F.try_divide(c, self._back(c, w, periods)) - 1, max(0, periods), max(0, -periods))

    def _filled(self, back: bool, limit: int | None) -> Frame:
        if limit is not None:
            frame = (0, limit) if back else (-limit, 0)
            return self._moving(lambda c, w: (F.first if back else F.last)(c, ignorenulls=True).over(w.rowsBetween(*frame)), 0 if back else limit, limit if back else 0, numeric=False)
        if not back:
            return self._transform(lambda src, order, cols: ordered.running(src, order, {f"__t_{c}": ("last", f"__c_{c}") for c in cols}, self._k), numeric=False)

        def make(src, order, cols):
            pos = ordered.with_position(src, [*self._k, *order]).withColumn("__neg", -F.col("__pos"))
            return ordered.running(pos, ["__neg"], {f"__t_{c}": ("last", f"__c_{c}") for c in cols}, self._k).drop("__pos", "__neg")

        return self._transform(make, numeric=False)

    def ffill(self, limit=None):
        return self._filled(False, limit)

    def bfill(self, limit=None):
        return self._filled(True, limit)

    pad, backfill = ffill, bfill

    def fillna(self, value=None, method=None, limit=None):
        if method is not None:
            return self.ffill(limit) if method in ("ffill", "pad") else self.bfill(limit)
        out = self.frame.fillna(value)
        return out._new(out.sdf, columns=self.columns)

    def transform(self, how, dtype="double"):
        """A group's aggregate, by name, beside each of its rows; or a Python function of each group's column, of the same length."""
        if callable(how):
            g = self._labelled()
            cols, order = g._numeric(), g.frame.order
            names = list(dict.fromkeys([*g.frame.index, *order]))
            src = g.frame.sdf.select(*g._k, *(F.col(n) for n in names if n not in cols), *(g.frame.col(c).alias(f"__c_{c}") for c in cols))
            kept = [n for n in names if n not in cols]
            schema = ", ".join([*(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in kept), *(f"`{c}` {spark_type(dtype)}" for c in cols)])

            def one(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values([o for o in order if o in kept])
                return pdf[kept].assign(**{c: how(pdf[f"__c_{c}"]) for c in cols})

            return Frame(src.groupBy(*g._k).applyInPandas(one, schema), cols, [i for i in g.frame.index if i in kept], [o for o in order if o in kept])

        def make(src, order, cols):
            got = src.groupBy(*(F.col(k).alias(f"{k}_") for k in self._k)).agg(*(scalars.AGGREGATES[how](F.col(f"__c_{c}")).alias(f"__t_{c}") for c in cols))
            return src.join(got, [src[k].eqNullSafe(got[f"{k}_"]) for k in self._k]).drop(*(f"{k}_" for k in self._k))

        return self._transform(make, numeric=how in scalars.NUMERIC_ONLY or how == "sum")

    # -- selections
    def _pick(self, cond, descending=False) -> Frame:
        g = self._ordered()
        sdf = g.frame.sdf.withColumn("__rn", F.row_number().over(g._window(descending)))
        return Frame(sdf.where(cond(F.col("__rn"))).drop("__rn"), list(dict.fromkeys([*(k for k in self.keys if k in g.frame.columns), *self.columns])), g.frame.index, g.frame.order)

    def head(self, n=5):
        return self._pick(lambda r: r <= n)

    def tail(self, n=5):
        return self._pick(lambda r: r <= n, descending=True)

    def nth(self, n):
        many = [n] if isinstance(n, int) else list(n)
        out = self._pick(lambda r: r.isin([x + 1 for x in many if x >= 0])) if any(x >= 0 for x in many) else None
        back = self._pick(lambda r: r.isin([-x for x in many if x < 0]), descending=True) if any(x < 0 for x in many) else None
        return out if back is None else back if out is None else out._new(out.sdf.unionByName(back.sdf))

    def take(self, indices):
        return self.nth(indices)

    def sample(self, n=None, frac=None, random_state=0):
        """Random rows of each group, by a hash of their order: the same rows for the same state."""
        g = self._ordered()
        at = F.xxhash64(F.lit(random_state), *g.frame.order)
        if n is not None:  # a top-n of each group, cut ahead of the shuffle
            w = Window.partitionBy(*self._k).orderBy(at, *g.frame.order)
            sdf = g.frame.sdf.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
        else:
            src = g.frame.sdf.withColumns({"__at": at, "__one": F.lit(1)})
            run = ordered.running(src, ["__at", *g.frame.order], {"__rn": ("sum", "__one")}, g._k)
            size = g.frame.sdf.groupBy(*(F.col(k).alias(f"{k}_") for k in self._k)).agg(F.round(F.count("*") * frac).alias("__lim"))
            sdf = run.join(size, [run[k].eqNullSafe(size[f"{k}_"]) for k in self._k]).where("__rn <= __lim").drop("__rn", "__lim", "__at", "__one", *(f"{k}_" for k in self._k))
        return Frame(sdf, g.frame.columns, g.frame.index, g.frame.order)

    def filter(self, pred) -> Frame:
        """Rows of groups for which an aggregate expression holds, e.g. ``lambda g: F.count('*') > 10``; a hot group is not gathered.

        A predicate of a group's pandas frame works too, a group in one task.
        """
        e = pred
        if callable(pred) and not isinstance(pred, Column):
            try:
                e = pred(self)
            except (TypeError, ValueError, AttributeError, KeyError):
                e = None
        if not isinstance(e, Column):
            cols = [c for c in self.frame.columns if not c.startswith("__g")]
            src = self.frame.sdf

            def one(pdf: pd.DataFrame) -> pd.DataFrame:
                return pdf if bool(pred(pdf[cols])) else pdf.iloc[:0]

            return Frame(src.groupBy(*self._k).applyInPandas(one, src.schema), self.frame.columns, self.frame.index, self.frame.order)
        kept = self.frame.sdf.groupBy(*(F.col(k).alias(f"{k}_") for k in self._k)).agg(e.alias("__p")).where("__p")
        sdf = self.frame.sdf.join(kept, [self.frame.sdf[k].eqNullSafe(kept[f"{k}_"]) for k in self._k], "left_semi")
        return Frame(sdf, self.frame.columns, self.frame.index, self.frame.order)

    # -- functions of the user
    def apply(self, func, schema: str | None = None, probe: int = 1000) -> DataFrame:
        """A Python function of each group's pandas frame; without ``schema`` it is read off the result for the first ``probe`` rows."""
        if schema is None:
            some = self.frame.sdf.select(*self.frame.columns).limit(probe).toPandas()
            got = func(some)
            got = got if isinstance(got, pd.DataFrame) else pd.DataFrame({"value": [got]} if not isinstance(got, pd.Series) else {"value": got})
            schema = self.frame.sdf.sparkSession.createDataFrame(got.reset_index(drop=True)).schema if len(got) else None
            if schema is None:
                raise ValueError("give the schema: the function returned no row to read it from")
            inner = func

            def func(pdf):
                out = inner(pdf)
                return out if isinstance(out, pd.DataFrame) else pd.DataFrame({"value": [out]} if not isinstance(out, pd.Series) else {"value": out})

        cols = list(dict.fromkeys(self.keys + self.frame.columns))
        src = self.frame.sdf.select(*self._k, *(F.col(c) for c in cols if c in self.frame.columns))
        return src.groupBy(*self._k).applyInPandas(lambda pdf: func(pdf[[c for c in pdf.columns if not c.startswith("__g")]]), schema)

    def agg_udf(self, func, dtype="double") -> Frame:
        """A Python function of each group's column."""
        def one(s: pd.Series) -> float:
            return func(s)

        u = F.pandas_udf(one, spark_type(dtype))
        return self._result([u(self.frame.col(c)).alias(c) for c in self._numeric()])

    def resample(self, rule: str, on: str, how: str = "count", fill: bool = False) -> Frame:
        """Aggregates of time buckets of each group; ``fill`` adds the empty buckets between a group's first and last."""
        g = GroupBy(Frame(self.frame.sdf, [c for c in self.frame.columns], self.frame.index, self.frame.order), [*self.keys, Grouper(on, rule)], as_index=False)
        out = g[[c for c in self.columns if c != on]].agg(how)
        out = out.to_frame() if isinstance(out, Series) else out
        if fill:
            n, unit = interval(rule)
            src = out.sdf
            ends = src.groupBy(*self.keys).agg(F.min(on).alias("lo"), F.max(on).alias("hi"))
            full = ends.select(*self.keys, F.explode(F.expr(f"sequence(lo, hi, INTERVAL '{n}' {unit})")).alias(on))
            out = out._new(full.join(src, [*self.keys, on], "left"))
        return out


def _labels(func, frame: Frame) -> Column:
    """A function of the labels: of their column expression, else of each label, its type read off the first."""
    c = F.col(frame.index[0])
    try:
        return _native(func, c)
    except (TypeError, ValueError):
        first = frame.sdf.select(c).head()
        return _vector(func, spark_type(type(func(first[0]))) if first else "string")(c)


def _aggregates():
    for how in ("sum", "prod", "count", "min", "max", "mean", "median", "std", "var", "sem", "skew", "nunique", "all", "any"):
        setattr(GroupBy, how, lambda self, how=how, **k: self._named(how, **k))


_aggregates()
