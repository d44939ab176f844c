"""``Frame`` and ``Series``: labelled, ordered frames as thin, lazy wrappers of Spark DataFrames.

A frame is a Spark DataFrame, the names of its data columns, of its index columns and of the columns that order it.
Without index columns the labels are positions; without order columns the order is that of the source, numbered
once when an operator needs it.  Relational operators never sort; only those that observe order use it.
"""

from __future__ import annotations

import math
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ordered, scalars
from ..plans.store import store

ORD = "__ord"
#: Order of joined rows: those of the left frame as they stood, then those of the right only.
_ORDERED = ("__oa IS NULL AS __z0", "__oa AS __z1", "__ob AS __z2")
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
# Dtype names and Spark types.
DTYPES = {"int": "bigint", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "float": "double", "float64": "double", "float32": "float", "str": "string", "object": "string", "string": "string", "category": "string", "bool": "boolean", "datetime64[ns]": "timestamp_ntz", "datetime": "timestamp_ntz"}


def spark_type(dtype) -> str:
    if isinstance(dtype, type):
        dtype = {int: "int64", float: "float64", str: "str", bool: "bool"}.get(dtype, dtype.__name__)
    return DTYPES.get(str(dtype), str(dtype))


class Frame:
    def __init__(self, sdf: DataFrame, columns: list[str] | None = None, index: list[str] = (), order: list[str] = ()):
        self.sdf, self.index, self.order = sdf, list(index), list(order)
        self.columns = list(columns) if columns is not None else [c for c in sdf.columns if c not in self.index and c != ORD]

    # -- plumbing
    def _keep(self) -> list[str]:
        return list(dict.fromkeys(self.columns + self.index + self.order))

    def _new(self, sdf: DataFrame, columns=None, index=None, order=None) -> Frame:
        return Frame(sdf, self.columns if columns is None else columns, self.index if index is None else index, self.order if order is None else order)

    def ordered(self) -> Frame:
        """This frame with order columns; a source's order is numbered and stored once."""
        if self.order:
            return self
        return Frame(store(self.sdf.withColumn(ORD, F.monotonically_increasing_id()), "ordered"), self.columns, self.index, [ORD])

    def labelled(self) -> Frame:
        """This frame with an index column: its positions where it has none."""
        if self.index:
            return self.ordered()
        o = self.ordered()
        return Frame(ordered.with_position(o.sdf, o.order, "__idx"), self.columns, ["__idx"], ["__idx"])

    def type(self, c: str) -> T.DataType:
        return self.sdf.schema[c].dataType

    def numeric(self) -> list[str]:
        return [c for c in self.columns if isinstance(self.type(c), _NUMERIC)]

    def col(self, c: str) -> Column:
        """A column with NaN as NULL."""
        return scalars.clean(F.col(f"`{c}`"), self.type(c).simpleString())

    def to_spark(self, index: bool = False) -> DataFrame:
        return self.sdf.select(*(F.col(f"`{c}`") for c in [*(self.index if index else []), *self.columns]))

    # -- 2.1 conversion
    def to_pandas(self):
        sdf = self.sdf.orderBy(*ordered._order(self.order)) if self.order else self.sdf
        out = sdf.select(*self.index, *self.columns).toPandas()
        return out.set_index(self.index) if self.index else out

    def to_numpy(self, dtype=None, copy=False, na_value=None):
        out = self.to_pandas()
        out = out.fillna(na_value) if na_value is not None else out
        return out.to_numpy(dtype=dtype, copy=copy)

    values = property(lambda self: self.to_numpy())
    __array__ = to_numpy

    def to_csv(self, path=None, sep=",", na_rep="", columns=None, header=True, index=True, mode="w", single=False, float_format=None, **options):
        """CSV parts under ``path``; the text itself, by way of the driver, if path is None.  ``single`` writes one file by one task."""
        cols = list(columns or self.columns)
        if path is None:
            return self[cols].to_pandas().to_csv(sep=sep, na_rep=na_rep, header=header, index=index, float_format=float_format, **options)
        rename = {"quotechar": "quote", "escapechar": "escape", "date_format": "timestampFormat", "encoding": "encoding", "compression": "compression"}
        out = lambda c: F.format_string(float_format, F.col(c).cast("double")) if float_format and isinstance(self.type(c), (T.FloatType, T.DoubleType, T.DecimalType)) else F.col(c)
        sdf = self.sdf.select(*(self.index if index else []), *(F.when(F.col(c).isNotNull(), out(c)).alias(c) for c in cols))
        w = (sdf.coalesce(1) if single else sdf).write.mode({"w": "overwrite", "a": "append"}[mode]).option("sep", sep).option("nullValue", na_rep).option("header", header)
        for k, v in options.items():
            w = w.option(rename.get(k, k), v)
        w.csv(path)

    def iterrows(self):
        sdf = self.sdf.orderBy(*ordered._order(self.order)) if self.order else self.sdf
        for at, r in enumerate(sdf.select(*self.index, *self.columns).toLocalIterator()):
            label = (tuple(r[: len(self.index)]) if len(self.index) > 1 else r[0]) if self.index else at
            yield label, dict(zip(self.columns, r[len(self.index) :], strict=True))

    def __iter__(self):
        return iter(self.columns)

    def __len__(self):
        return self.sdf.count()

    shape = property(lambda self: (len(self), len(self.columns)))
    size = property(lambda self: len(self) * len(self.columns))
    empty = property(lambda self: not self.columns or self.sdf.isEmpty())
    dtypes = property(lambda self: {c: self.type(c).simpleString() for c in self.columns})
    ndim = 2

    def memory_usage(self, index=True, deep=False) -> dict[str, int]:
        """Bytes of each column: widths of fixed types, lengths of texts and arrays."""
        cols = (self.index if index else []) + self.columns

        def width(c):
            t = self.type(c)
            if isinstance(t, (T.StringType, T.BinaryType)):
                return F.sum(F.octet_length(F.col(c)) if deep else F.lit(8))
            if isinstance(t, T.ArrayType):
                return F.sum(8 * F.size(c))
            return F.sum(F.lit({"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4}.get(t.simpleString(), 8)))

        r = self.sdf.agg(*(F.coalesce(width(c), F.lit(0)).cast("long").alias(c) for c in cols)).first()
        return r.asDict()

    # -- 2.2 projection and mutation
    def __getitem__(self, key):
        if isinstance(key, str):
            if key not in self.columns:
                raise KeyError(key)
            return Series(self._new(self.sdf), self.col(key), key)  # of this frame as it is now
        if isinstance(key, slice):
            return self.iloc[key]
        if isinstance(key, Series):
            return self.filter(key)
        key = list(key)
        if key and all(isinstance(k, bool) for k in key):
            return self.iloc[[i for i, k in enumerate(key) if k]]
        missing = [k for k in key if k not in self.columns]
        if missing:
            raise KeyError(missing)
        out = self._new(self.sdf, columns=key)
        if hasattr(self, "_made"):
            out._made = self._made
        return out

    def __getattr__(self, name):
        if not name.startswith("_") and name in self.__dict__.get("columns", ()):
            return self[name]
        raise AttributeError(name)

    def filter(self, mask: Series | Column) -> Frame:
        return self._new(self.sdf.where(mask.expr if isinstance(mask, Series) else mask))

    def assign(self, **new) -> Frame:
        """Columns from scalars, expressions or series of this frame; other series align on labels, lists on positions."""
        out = self
        for name, v in new.items():
            if isinstance(v, (list, tuple)):
                o = out.labelled() if not out.index else out.ordered()
                pos = ordered.with_position(o.sdf, o.order)
                if pos.count() != len(v):
                    raise ValueError(f"{len(v)} values for {pos.count()} rows")
                given = pos.sparkSession.createDataFrame(list(enumerate(v)), ["__pos", "__v"])
                sdf = pos.drop(*([name] if name in pos.columns else [])).join(given, "__pos").withColumnRenamed("__v", name).drop("__pos")
                out = Frame(sdf, [*[c for c in out.columns if c != name], name] if name not in out.columns else out.columns, o.index, o.order)
                continue
            if isinstance(v, Series) and v.frame.sdf is not out.sdf:
                if v.frame.sdf is self.sdf:
                    v = v.expr
                else:
                    a, b = out.labelled(), v.frame.labelled()
                    right = b.sdf.select(*(F.col(i).alias(f"__r{n}") for n, i in enumerate(b.index)), v.expr.alias("__v"))
                    cond = [a.sdf[i].eqNullSafe(right[f"__r{n}"]) for n, i in enumerate(a.index)]
                    sdf = a.sdf.drop(*([name] if name in out.columns else [])).join(right, cond, "left").drop(*(f"__r{n}" for n in range(len(b.index)))).withColumnRenamed("__v", name)
                    out = Frame(sdf, out.columns if name in out.columns else [*out.columns, name], a.index, a.order)
                    continue
            e = v.expr if isinstance(v, Series) else v if isinstance(v, Column) else F.lit(v)
            out = out._new(out.sdf.withColumn(name, e), columns=out.columns if name in out.columns else [*out.columns, name])
        return out

    def _become(self, new: Frame) -> None:
        self.__dict__.pop("_made", None)
        self.__dict__.update({k: v for k, v in new.__dict__.items() if k != "_made"})

    def __setitem__(self, key, value) -> None:
        """``f[name] = v``, ``f[[names]] = v`` (a scalar, a value or series a column, a frame) and ``f[mask] = v``: this object then stands for the new frame."""
        if isinstance(key, str):
            return self._become(self.assign(**{key: value}))
        if isinstance(key, (Series, Frame)):
            return self._become(self.mask(key, value))
        names = list(key)
        if isinstance(value, Frame):
            if len(value.columns) != len(names):
                raise ValueError(f"{len(value.columns)} columns for {len(names)} names")
            value = [Series(value, value.col(c), c) for c in value.columns]
        values = list(value) if isinstance(value, (list, tuple)) else [value] * len(names)
        if len(values) != len(names):
            raise ValueError(f"{len(values)} values for {len(names)} names")
        self._become(self.assign(**dict(zip(names, values, strict=True))))

    def insert(self, loc: int, column: str, value, allow_duplicates: bool = False) -> Frame:
        if column in self.columns:
            raise ValueError(f"cannot insert {column}, already exists")
        if not 0 <= loc <= len(self.columns):
            raise IndexError(loc)
        out = self.assign(**{column: value})
        return out._new(out.sdf, columns=[*self.columns[:loc], column, *self.columns[loc:]])

    def drop(self, labels=None, axis=0, index=None, columns=None, level=None, errors="raise") -> Frame:
        as_list = lambda x: [] if x is None else list(x) if isinstance(x, (list, tuple, set)) else [x]
        cols, rows = as_list(columns), as_list(index)
        (cols if axis in (1, "columns") else rows).extend(as_list(labels))
        missing = [c for c in cols if c not in self.columns]
        if missing and errors == "raise":
            raise KeyError(missing)
        out = self._new(self.sdf, columns=[c for c in self.columns if c not in cols])
        if rows:
            o = out.labelled()
            at = o.index[0] if level is None else o.index[level] if isinstance(level, int) else level
            if errors == "raise":
                found = {r[0] for r in o.sdf.where(F.col(at).isin(rows)).select(at).distinct().collect()}
                if set(rows) - found:
                    raise KeyError(sorted(set(rows) - found, key=str))
            out = o._new(o.sdf.where(~scalars.isin(F.col(at), rows)))
        return out

    def rename(self, mapper=None, *, index=None, columns=None, axis=0) -> Frame:
        columns, index = (columns, mapper) if mapper is not None and axis in (0, "index") else (mapper if mapper is not None else columns, index)
        out = self
        if columns:
            new = {c: columns(c) if callable(columns) else columns.get(c, c) for c in self.columns}
            taken = set(self.index + self.order)
            sdf = self.sdf.select(*(F.col(f"`{c}`").alias(n) for c, n in new.items()), *(c for c in dict.fromkeys(self.index + self.order) if c not in new.values()))
            order = [new.get(c, c) for c in self.order]
            out = Frame(sdf, list(new.values()), [i for i in self.index], order) if not taken & set(new) else Frame(sdf, list(new.values()), [new.get(i, i) for i in self.index], order)
        if index:
            o = out.labelled()
            i = F.col(o.index[0])
            if callable(index):
                e = _vector(index, o.type(o.index[0]).simpleString())(i)
            else:
                e = F.coalesce(F.create_map(*(F.lit(x) for kv in index.items() for x in kv))[i], i)
            order = o.order
            sdf = o.sdf
            if o.index[0] in order:
                sdf, order = sdf.withColumn("__was", i), ["__was" if c == o.index[0] else c for c in order]
            out = o._new(sdf.withColumn(o.index[0], e), order=order)
        return out

    def set_axis(self, labels, axis=0) -> Frame:
        if axis in (1, "columns"):
            if len(labels) != len(self.columns):
                raise ValueError(f"{len(labels)} labels for {len(self.columns)} columns")
            return self.rename(columns=dict(zip(self.columns, map(str, labels), strict=True)))
        return self.assign(__lab=list(labels)).set_index("__lab")

    def reindex(self, labels=None, index=None, columns=None, axis=0, method=None, fill_value=None, limit=None) -> Frame:
        if labels is not None:
            index, columns = (index, labels) if axis in (1, "columns") else (labels, columns)
        out = self
        if columns is not None:
            fill = F.lit(fill_value)
            sdf = out.sdf.select(*(F.col(c) if c in out.columns else fill.alias(c) for c in columns), *(c for c in dict.fromkeys(out.index + out.order) if c not in columns))
            out = Frame(sdf, list(columns), out.index, out.order)
        if index is not None:
            o = out.labelled()
            i = o.index[0]
            want = o.sdf.sparkSession.createDataFrame(list(enumerate(index)), f"__at long, `{i}` {o.type(i).simpleString()}")
            have = o.sdf.select(F.col(i), F.lit(True).alias("__hit"), *(c for c in o.columns if c != i))
            sdf = want.join(have, i, "left").drop(*(c for c in [ORD] if c not in o.columns))
            if method:
                fill = {"ffill": "last", "pad": "last", "bfill": "first", "backfill": "first"}[method]
                out = Frame(sdf, o.columns, o.index, ["__at"]).fillna(method="ffill" if fill == "last" else "bfill", limit=limit)
                return out
            if fill_value is not None:
                sdf = sdf.withColumns({c: F.when(F.col("__hit").isNull(), F.lit(fill_value).cast(o.type(c))).otherwise(F.col(c)) for c in o.columns if c != i})
            out = Frame(sdf.drop("__hit"), o.columns, o.index, ["__at"])
        return out

    def set_index(self, keys, drop=True, append=False, verify_integrity=False) -> Frame:
        keys = [keys] if isinstance(keys, str) else list(keys)
        missing = [k for k in keys if k not in self.columns]
        if missing:
            raise KeyError(missing)
        base = self.labelled() if append and not self.index else self
        index = (base.index if append else []) + keys
        if verify_integrity and not base.sdf.groupBy(*index).count().where("count > 1").isEmpty():
            raise ValueError("index has duplicate keys")
        return base._new(base.sdf, columns=[c for c in self.columns if not (drop and c in keys)], index=index)

    def reset_index(self, level=None, drop=False) -> Frame:
        if not self.index:
            if drop:
                return self
            o = self.labelled()
            return Frame(o.sdf.withColumnRenamed("__idx", "index"), ["index", *self.columns], [], ["index"])
        gone = self.index if level is None else [self.index[x] if isinstance(x, int) else x for x in (level if isinstance(level, (list, tuple)) else [level])]
        return self._new(self.sdf, columns=([] if drop else gone) + self.columns, index=[i for i in self.index if i not in gone])

    def droplevel(self, level, axis=0) -> Frame:
        return self.reset_index(level, drop=True)

    def squeeze(self, axis=None):
        if len(self.columns) == 1:
            rows = self.sdf.select(*self.columns).head(2)
            return rows[0][0] if len(rows) == 1 and axis is None else self[self.columns[0]]
        return self

    def transpose(self) -> Frame:
        """Rows become columns: for frames of few rows, within spark.sql.transposeMaxValues; labels become text."""
        o = self.labelled()
        kind = "string" if any(isinstance(self.type(c), T.StringType) for c in self.columns) else "double" if any(isinstance(self.type(c), (T.FloatType, T.DoubleType)) for c in self.columns) else None
        cast = lambda c: F.col(c).cast(kind) if kind else F.col(c)
        sdf = o.sdf.select(F.col(o.index[0]).cast("string").alias("__lab"), *(cast(c).alias(c) for c in self.columns)).transpose(F.col("__lab"))
        place = F.create_map(*(x for n, c in enumerate(self.columns) for x in (F.lit(c), F.lit(n))))
        return Frame(sdf.withColumn(ORD, place[F.col("key")]), [c for c in sdf.columns if c != "key"], ["key"], [ORD])

    T = property(lambda self: self.transpose())

    def astype(self, dtype, copy=True, errors="raise") -> Frame:
        kinds = dtype if isinstance(dtype, dict) else {c: dtype for c in self.columns}
        missing = [c for c in kinds if c not in self.columns]
        if missing:
            raise KeyError(missing)
        how = (lambda c, t: F.col(c).cast(t)) if errors == "raise" else (lambda c, t: F.expr(f"try_cast(`{c}` AS {t})"))
        return self._new(self.sdf.withColumns({c: how(c, spark_type(t)) for c, t in kinds.items()}))

    def copy(self, deep=True) -> Frame:
        return self._new(self.sdf)

    # -- 2.3 predicates
    def _each(self, f, cols=None) -> Frame:
        cols = self.columns if cols is None else cols
        made = {c: f(c) for c in cols}
        out = self._new(self.sdf.withColumns(made))
        out._made = (self.sdf, made)
        return out

    def _of(self, parent: Frame) -> dict[str, Column] | None:
        """This frame's columns as expressions over ``parent``, if it was made from it column by column."""
        if self.sdf is parent.sdf:
            return {c: self.col(c) for c in self.columns}
        source, made = getattr(self, "_made", (None, None))
        return {c: made.get(c, parent.col(c)) for c in self.columns if c in made or c in parent.columns} if source is parent.sdf else None

    def isna(self) -> Frame:
        return self._each(lambda c: self.col(c).isNull())

    isnull = isna

    def notna(self) -> Frame:
        return self._each(lambda c: self.col(c).isNotNull())

    def isin(self, values) -> Frame:
        if isinstance(values, dict):
            return self._each(lambda c: scalars.isin(self.col(c), values[c]) if c in values else F.lit(False))
        if isinstance(values, (Frame, Series)):
            other = values if isinstance(values, Frame) else Frame(values.frame.sdf.select(*(values.expr.alias(c) for c in self.columns), *values.frame.index, *values.frame.order), self.columns, values.frame.index, values.frame.order)
            return self._zip(other, lambda a, b: scalars.eq(a, b), how="left")
        return self._each(lambda c: scalars.isin(self.col(c), values))

    def dropna(self, axis=0, how="any", thresh=None, subset=None) -> Frame:
        if axis in (1, "columns"):
            r = self.sdf.agg(F.count("*").alias("__n"), *(F.count(self.col(c)).alias(c) for c in self.columns)).first()
            least = thresh if thresh is not None else r["__n"] if how == "any" else 1
            return self._new(self.sdf, columns=[c for c in self.columns if r[c] >= least])
        cols = list(subset or self.columns)
        full = sum((self.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
        least = thresh if thresh is not None else len(cols) if how == "any" else 1
        return self._new(self.sdf.where(full >= least))

    def _choose(self, cond, other, turned: bool) -> Frame:
        """Cells where ``cond`` holds (or doesn't, if turned), else those of ``other``: scalars, series or frames, aligned on labels where they are of another frame."""
        cond, other = (x(self) if callable(x) and not isinstance(x, (Frame, Series, Column)) else x for x in (cond, other))
        base, sides = self, {}
        for name, x in (("c", cond), ("o", other)):
            if isinstance(x, Series):
                if x.frame.sdf is self.sdf or getattr(x.frame, "_made", (None,))[0] is self.sdf:
                    sides[name] = lambda c, e=x.expr: e
                    continue
                x = Frame(x.frame.sdf.withColumn("__v", x.expr).select(*dict.fromkeys([*x.frame.index, *x.frame.order]), *(F.col("__v").alias(c) for c in self.columns)), self.columns, x.frame.index, x.frame.order)
            if isinstance(x, Frame):
                of = x._of(self)
                if of is None:
                    b = x.labelled()
                    base = base.labelled()
                    right = b.sdf.select(*(F.col(i).alias(f"__{name}i{n}") for n, i in enumerate(b.index)), *(b.col(c).alias(f"__{name}_{c}") for c in x.columns))
                    sdf = base.sdf.join(right, [base.sdf[i].eqNullSafe(right[f"__{name}i{n}"]) for n, i in enumerate(base.index)], "left")
                    base = base._new(sdf)
                    of = {c: F.col(f"__{name}_{c}") for c in x.columns}
                missing = F.lit(False) if name == "c" else F.lit(None)
                sides[name] = lambda c, of=of, missing=missing: of.get(c, missing)
            else:
                sides[name] = lambda c, e=x if isinstance(x, Column) else F.lit(x): e
        hold = lambda c: F.coalesce(sides["c"](c).cast("boolean"), F.lit(False))
        keep = (lambda c: ~hold(c)) if turned else hold
        return base._each(lambda c: F.when(keep(c), self.col(c)).otherwise(sides["o"](c)), self.columns)._new_from(self)

    def _new_from(self, parent: Frame) -> Frame:
        return Frame(self.sdf.select(*dict.fromkeys([*parent.columns, *self.index, *self.order])), parent.columns, self.index, self.order)

    def where(self, cond, other=None) -> Frame:
        return self._choose(cond, other, False)

    def mask(self, cond, other=None) -> Frame:
        return self._choose(cond, other, True)

    def __invert__(self) -> Frame:
        return self._each(lambda c: ~F.col(c) if isinstance(self.type(c), T.BooleanType) else F.bitwise_not(c))

    def equals(self, other: Frame) -> bool:
        if self.columns != other.columns or list(self.dtypes.values()) != list(other.dtypes.values()):
            return False
        a, b = self.labelled(), other.labelled()
        a, b = (ordered.with_position(x.sdf, x.order).select("__pos", *x.index, *(x.col(c).alias(c) for c in x.columns)) for x in (a, b))
        b = b.toDF(*a.columns)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    # -- labels meet
    def _zip(self, other: Frame, op, how="full", level=None) -> Frame:
        """``op`` on the columns of two frames aligned on labels, or on one level of them; columns of one side only meet NULL."""
        a, b = self.labelled(), other.labelled()
        if level is not None:
            how, at = "left", a.index[level] if isinstance(level, int) else level
        cols = list(dict.fromkeys([*self.columns, *(other.columns if how == "full" else [])]))
        left = a.sdf.select(*(F.col(i).alias(f"__i{n}") for n, i in enumerate(a.index)), *(a.col(c).alias(f"__a_{c}") for c in a.columns), F.struct(*a.order).alias("__oa"))
        right = b.sdf.select(*(F.col(i).alias(f"__j{n}") for n, i in enumerate(b.index)), *(b.col(c).alias(f"__b_{c}") for c in b.columns), F.struct(*b.order).alias("__ob"))
        cond = [left[f"__i{n}"].eqNullSafe(right[f"__j{n}"]) for n in range(len(a.index))] if level is None else [left[f"__i{a.index.index(at)}"].eqNullSafe(right["__j0"])]
        j = left.join(right, cond, how)
        side = lambda s, c, f: F.col(f"__{s}_{c}") if c in f.columns else F.lit(None)
        idx = [(F.coalesce(f"__i{n}", f"__j{n}") if level is None else F.col(f"__i{n}")).alias(i) for n, i in enumerate(a.index)]
        sdf = j.select(*idx, *(op(side("a", c, self), side("b", c, other)).alias(c) for c in cols), *map(F.expr, _ORDERED))
        return Frame(sdf, cols, a.index, ["__z0", "__z1", "__z2"])

    def _binary(self, other, op, fill=None, axis=None, level=None) -> Frame:
        """``axis`` says what a series' labels are: rows (the default for one of this frame), or names of columns."""
        if isinstance(other, Series) and axis in (1, "columns"):
            other = other.to_dict()  # a value a column
        if isinstance(other, Frame):
            if other.sdf is self.sdf and level is None:
                return self._each(lambda c: scalars.filled(op, self.col(c), other.col(c), fill))
            return self._zip(other, lambda a, b: scalars.filled(op, a, b, fill), level=level)
        if isinstance(other, Series) and (level is not None or (axis in (0, "index") and other.frame.sdf is not self.sdf)):
            v = other.frame.sdf.withColumn("__v", other.expr)
            wide = Frame(v.select(*dict.fromkeys([*other.frame.index, *other.frame.order]), *(F.col("__v").alias(c) for c in self.columns)), self.columns, other.frame.index, other.frame.order)
            return self._zip(wide, lambda a, b: scalars.filled(op, a, b, fill), level=level)
        if isinstance(other, Series):
            e = other.expr if other.frame.sdf is self.sdf else None
            if e is None:
                raise ValueError("align a series of another frame with assign first")
            return self._each(lambda c: scalars.filled(op, self.col(c), e, fill))
        if isinstance(other, dict):
            return self._each(lambda c: scalars.filled(op, self.col(c), F.lit(other.get(c)), fill))
        return self._each(lambda c: scalars.filled(op, self.col(c), F.lit(other), fill))

    def align(self, other: Frame, join="outer", fill_value=None) -> tuple[Frame, Frame]:
        how = {"outer": "full"}.get(join, join)
        cols = list(dict.fromkeys([*self.columns, *other.columns])) if join == "outer" else [c for c in self.columns if c in other.columns] if join == "inner" else self.columns if join == "left" else other.columns
        fill = (lambda e: F.coalesce(e, F.lit(fill_value))) if fill_value is not None else (lambda e: e)
        pick = lambda f: self.reindex(columns=cols)._zip(other.reindex(columns=cols), f, how=how)
        return pick(lambda a, b: fill(a)), pick(lambda a, b: fill(b))

    def combine(self, other: Frame, func, fill_value=None, overwrite=True) -> Frame:
        """``func`` of two column expressions for each column, over labels aligned outward."""
        fill = (lambda e: F.coalesce(e, F.lit(fill_value))) if fill_value is not None else (lambda e: e)
        return self._zip(other, lambda a, b: func(fill(a), fill(b)))

    # -- 2.4 joins
    def merge(self, right: Frame, how="inner", on=None, left_on=None, right_on=None, left_index=False, right_index=False, suffixes=("_x", "_y"), sort=False, indicator=False, validate=None) -> Frame:
        """Null keys match each other, as they do for data frames."""
        as_list = lambda x: [x] if isinstance(x, str) else list(x or [])
        left, right = (self.labelled() if left_index else self), (right.labelled() if right_index else right)
        lk, rk = as_list(on or left_on), as_list(on or right_on)
        lk, rk = (left.index if left_index else lk), (right.index if right_index else rk)
        if how != "cross" and not lk and not rk:
            lk = rk = [c for c in left.columns if c in right.columns]
            if not lk:
                raise ValueError("no common columns to merge on")
        if validate:
            one = validate.replace("one", "1").replace("many", "m").split("_to_" if "_to_" in validate else ":")
            for side, keys, kind in ((left, lk, one[0]), (right, rk, one[1])):
                if kind == "1" and not side.sdf.groupBy(*keys).count().where("count > 1").isEmpty():
                    raise ValueError(f"merge keys are not unique: {keys}")
        shared = set() if left_index or right_index else {a for a, b in zip(lk, rk, strict=True) if a == b}
        clash = (set(left.columns) & set(right.columns)) - shared
        ln = {c: c + suffixes[0] if c in clash else c for c in left.columns}
        rn = {c: c + suffixes[1] if c in clash else c for c in right.columns}
        a = left.sdf.select(*(F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(lk)), *(F.col(f"`{c}`").alias(f"__l_{c}") for c in left.columns), F.lit(True).alias("__l"))
        b = right.sdf.select(*(F.col(f"`{k}`").alias(f"__m{n}") for n, k in enumerate(rk)), *(F.col(f"`{c}`").alias(f"__r_{c}") for c in right.columns), F.lit(True).alias("__r"))
        if how == "cross":
            j = a.crossJoin(b)
        else:
            j = a.join(b, [a[f"__k{n}"].eqNullSafe(b[f"__m{n}"]) for n in range(len(lk))], {"outer": "full"}.get(how, how))
        out = [F.coalesce(f"__l_{c}", f"__r_{c}").alias(c) if c in shared else F.col(f"__l_{c}").alias(ln[c]) for c in left.columns]
        out += [F.col(f"__r_{c}").alias(rn[c]) for c in right.columns if c not in shared]
        cols = [ln[c] for c in left.columns] + [rn[c] for c in right.columns if c not in shared]
        if indicator:
            name = indicator if isinstance(indicator, str) else "_merge"
            out.append(F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both").alias(name))
            cols.append(name)
        index = []
        if left_index and right_index:
            index = left.index
            out += [F.coalesce(f"__k{n}", f"__m{n}").alias(i) for n, i in enumerate(index)]
        sdf = j.select(*out)
        keys = [c for c in cols if c in (lk if how != "right" else rk)]
        return Frame(sdf, cols, index, keys if sort or how == "outer" else [])

    # -- 2.5 aggregation
    def stat(self, how: str, axis=0, skipna=True, numeric_only=None, ddof=1, min_count=0, level=None):
        """A named aggregate: of each column as a dict, of each row as a series, or by a level of the labels as a frame."""
        if level is not None:
            g = self.groupby(level=level)
            cols = [c for c in self.columns if c in (self.numeric() if how in scalars.NUMERIC_ONLY or how == "sum" or numeric_only else self.columns)]
            return g._result([self._agg(how, self.col(c), ddof, min_count, skipna).alias(c) for c in cols])
        cols = self.numeric() if how in scalars.NUMERIC_ONLY or numeric_only else self.columns
        if axis in (1, "columns"):
            return Series(self, _across(how, [self.col(c) for c in cols], skipna, ddof), how)
        r = self.sdf.agg(*(self._agg(how, self.col(c), ddof, min_count, skipna).alias(c) for c in cols)).first()
        return r.asDict()

    @staticmethod
    def _agg(how: str, c: Column, ddof=1, min_count=0, skipna=True) -> Column:
        out = scalars.AGGREGATES[how](c)
        if how in ("std", "var", "sem") and ddof != 1:
            n = F.count(c)
            v = F.when(n > ddof, F.var_pop(c) * n / (n - ddof))
            out = {"var": v, "std": F.sqrt(v), "sem": F.sqrt(v / n)}[how]
        if min_count > 0:
            out = F.when(F.count(c) >= min_count, out)
        if not skipna and how not in ("count", "size", "nunique"):
            out = F.when(F.count(F.when(c.isNull(), 1)) == 0, out)
        return out

    def agg(self, func=None, axis=0):
        """Aggregates by name, list of names or dict of them; a list gives a frame with a row a function."""
        if isinstance(func, str):
            return self.stat(func, axis)
        if callable(func):
            return self.apply(func, axis)
        jobs = {c: [f] if isinstance(f, str) else list(f) for c, f in func.items()} if isinstance(func, dict) else {c: list(func) for c in self.columns}
        if isinstance(func, dict) and all(isinstance(f, str) for f in func.values()):
            return self.sdf.agg(*(self._agg(f, self.col(c)).alias(c) for c, f in func.items())).first().asDict()
        names = list(dict.fromkeys(f for fs in jobs.values() for f in fs))
        one = self.sdf.agg(*(self._agg(f, self.col(c)).alias(f"{f}\n{c}") for c, fs in jobs.items() for f in fs))
        rows = F.array(*(F.struct(F.lit(n).alias("__at"), F.lit(f).alias("func"), *((F.col(f"`{f}\n{c}`").cast("double") if f in jobs[c] else F.lit(None).cast("double")).alias(c) for c in jobs)) for n, f in enumerate(names)))
        return Frame(one.select(F.inline(rows)), list(jobs), ["func"], ["__at"])

    # -- groups
    def groupby(self, by=None, axis=0, level=None, as_index=True, sort=True, dropna=True, observed=False):
        from .groupby import GroupBy

        return GroupBy(self, by, level, as_index, sort, dropna)

    # -- 2.8 windows
    def _cum(self, how: str, axis=None, skipna=True, cols=None) -> Frame:
        cols = cols or (self.numeric() if how in ("sum", "prod") else self.columns)
        if axis in (1, "columns"):
            join = {"sum": lambda a, b: a + b, "prod": lambda a, b: a * b, "min": F.least, "max": F.greatest}[how]
            made, so_far, holes = {}, None, F.lit(False)
            for c in cols:
                e = self.col(c)
                so_far = e if so_far is None else F.coalesce(join(so_far, e), so_far, e)
                holes = holes | e.isNull()
                made[c] = F.when(~(e.isNull() if skipna else holes), so_far)
            return self._each(lambda c: made[c], cols)
        o = self.ordered()
        if set(cols) & set(o.order):
            raise ValueError("a column that orders the frame can't be replaced; order it by another")
        src = o.sdf.select(*o._keep()).withColumns({f"__c_{c}": o.col(c) for c in cols} | ({} if skipna else {f"__h_{c}": o.col(c).isNull().cast("long") for c in cols}))
        jobs = {f"__n_{c}": (how, f"__c_{c}") for c in cols} | ({} if skipna else {f"__s_{c}": ("sum", f"__h_{c}") for c in cols})
        out = ordered.running(src, o.order, jobs)
        new = o._new(out.drop(*(f"__c_{c}" for c in cols)))
        new = new._each(lambda c: F.col(f"__n_{c}") if skipna else F.when(F.col(f"__s_{c}") == 0, F.col(f"__n_{c}")), cols)
        return new._new_from(o)

    def running(self, **named: tuple[str, str]) -> Frame:
        """Columns ``new=(column, how)``, how being sum, prod, min, max or last, over all rows up to each: all in one pass."""
        o = self.ordered()
        src = o.sdf.select(*o._keep()).withColumns({f"__c_{c}": o.col(c) for c, _ in named.values()})
        out = ordered.running(src, o.order, {n: (how, f"__c_{c}") for n, (c, how) in named.items()})
        return o._new(out.drop(*(f"__c_{c}" for c, _ in named.values())), columns=[*(c for c in self.columns if c not in named), *named])

    def ranks(self, column: str, ascending=True, na_option="keep", **named: str) -> Frame:
        """Columns ``new=method`` with ranks of one column: all in one pass."""
        o = self.ordered()
        src = o.sdf.select(*o._keep()).withColumn("__rv", o.col(column))
        return o._new(ordered.ranked(src, "__rv", named, ascending, o.order, na_option).drop("__rv"), columns=[*self.columns, *named])

    def cumsum(self, axis=None, skipna=True):
        return self._cum("sum", axis, skipna)

    def cumprod(self, axis=None, skipna=True):
        return self._cum("prod", axis, skipna)

    def cummin(self, axis=None, skipna=True):
        return self._cum("min", axis, skipna)

    def cummax(self, axis=None, skipna=True):
        return self._cum("max", axis, skipna)

    def rank(self, axis=0, method="average", numeric_only=None, na_option="keep", ascending=True, pct=False) -> Frame:
        if axis in (1, "columns"):
            return self._rank_across(self.numeric() if numeric_only else self.columns, method, na_option, ascending, pct)
        out = self.ordered()
        for c in self.numeric() if numeric_only else self.columns:
            sdf = ordered.ranked(out.sdf.withColumn("__rv", out.col(c)), "__rv", {f"__r_{c}": method}, ascending, out.order, na_option, pct).drop("__rv")
            order = out.order
            if c in order:
                sdf, order = sdf.withColumn(f"__o_{c}", F.col(c)), [f"__o_{c}" if x == c else x for x in order]
            out = out._new(sdf.withColumn(c, F.col(f"__r_{c}")).drop(f"__r_{c}"), order=order)
        return out

    def _rank_across(self, cols, method, na_option, ascending, pct) -> Frame:
        """Ranks within each row."""
        e = {c: self.col(c).cast("double") for c in cols}
        ahead = (lambda a, b: a < b) if ascending else (lambda a, b: a > b)
        count = lambda conds: sum((F.coalesce(x, F.lit(False)).cast("int") for x in conds), F.lit(0))
        nulls = count(x.isNull() for x in e.values())

        def one(c):
            v = e[c]
            low = count(ahead(e[d], v) for d in cols)
            same = count(e[d] == v for d in cols)
            dense = F.size(F.array_distinct(F.array_compact(F.array(*(F.when(ahead(e[d], v), e[d]) for d in cols)))))
            got = {"min": low + 1, "max": low + same, "average": low + (same + 1) / 2.0, "dense": dense + 1, "first": low + 1 + count(e[d] == v for d in cols[: cols.index(c)])}[method]
            of = F.lit(len(cols)) - nulls
            if na_option == "top":
                got, of = got + F.when(nulls > 0, F.lit(1) if method == "dense" else nulls).otherwise(0), F.lit(len(cols))
            at = F.when(nulls > 0, 1)
            if na_option == "bottom":
                of = F.lit(len(cols))
            lost = F.lit(None) if na_option == "keep" else {"min": F.lit(1), "max": nulls, "average": (nulls + 1) / 2.0, "dense": F.lit(1), "first": 1 + count(e[d].isNull() for d in cols[: cols.index(c)])}[method]
            if na_option == "bottom":
                lost = lost + (F.size(F.array_distinct(F.array_compact(F.array(*e.values())))) if method == "dense" else F.lit(len(cols)) - nulls)
            out = F.when(v.isNotNull(), got).otherwise(lost if na_option != "keep" else F.lit(None)).cast("double")
            if pct:
                of = F.size(F.array_distinct(F.array_compact(F.array(*e.values())))) + (F.coalesce(at, F.lit(0)) if na_option != "keep" else 0) if method == "dense" else of
                out = F.try_divide(out, of)
            return out

        return self._each(one, cols)

    def fillna(self, value=None, method=None, limit=None) -> Frame:
        if method is None:
            values = value if isinstance(value, dict) else {c: value for c in self.columns if _fits(self.type(c), value)}
            return self._each(lambda c: F.coalesce(self.col(c), F.lit(values[c])), [c for c in self.columns if c in values])
        back = {"ffill": False, "pad": False, "bfill": True, "backfill": True}[method]
        o = self.ordered()
        cols = [c for c in o.columns if c not in o.order]
        src = o.sdf.select(*o._keep()).withColumns({f"__c_{c}": o.col(c) for c in cols})
        if limit is not None:
            frame = (0, limit) if back else (-limit, 0)
            pick = F.first if back else F.last
            src = ordered.moving(src, o.order, {f"__n_{c}": (lambda w, c=c: pick(f"__c_{c}", ignorenulls=True).over(w.rowsBetween(*frame))) for c in cols}, 0 if back else limit, limit if back else 0)
        elif back:
            pos = ordered.with_position(src, o.order).withColumn("__neg", -F.col("__pos"))
            src = ordered.running(pos, ["__neg"], {f"__n_{c}": ("last", f"__c_{c}") for c in cols}).drop("__pos", "__neg")
        else:
            src = ordered.running(src, o.order, {f"__n_{c}": ("last", f"__c_{c}") for c in cols})
        return o._new(src)._each(lambda c: F.col(f"__n_{c}"), cols)

    def replace(self, to_replace=None, value=None, regex=False, limit=None, method=None) -> Frame:
        if method in ("pad", "ffill", "bfill", "backfill") and value is None and not isinstance(to_replace, dict):
            gone = to_replace if isinstance(to_replace, (list, tuple)) else [to_replace]
            return self._each(lambda c: F.when(~scalars.isin(F.col(c), gone), F.col(c))).fillna(method=method, limit=limit)
        pairs = list(to_replace.items()) if isinstance(to_replace, dict) else list(zip(to_replace, value if isinstance(value, (list, tuple)) else [value] * len(to_replace), strict=True)) if isinstance(to_replace, (list, tuple)) else [(to_replace, value)]
        if isinstance(to_replace, dict) and value is None and all(isinstance(v, dict) for v in to_replace.values()):
            out = self
            for c, m in to_replace.items():
                out = out._new(out[[c]].replace(m, regex=regex).sdf)
            return self._new(out.sdf)

        def one(c):
            e, text = F.col(c), isinstance(self.type(c), T.StringType)
            if regex:
                for k, v in pairs:
                    e = F.regexp_replace(e, k, v) if text else e
                return e
            out = None
            for k, v in pairs:
                if not (k is None or _fits(self.type(c), k)):
                    continue
                hit = F.col(c).isNull() if k is None else F.col(c) == k
                out = (F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v)))
            return e if out is None else out.otherwise(e)

        return self._each(one)

    # -- 2.9 order
    def sort_values(self, by, axis=0, ascending=True, na_position="last", ignore_index=False, key=None) -> Frame:
        """The frame ordered by ``by``; stable: ties keep their order.  Nothing is moved until rows are asked for in order."""
        if axis in (1, "columns"):  # columns by the values of a row
            row = self.loc[[by] if not isinstance(by, list) else by].sdf.select(*self.columns).first()
            known, null = [c for c in self.columns if row[c] is not None], [c for c in self.columns if row[c] is None]
            known = sorted(known, key=lambda c: row[c], reverse=not ascending)
            return self._new(self.sdf, columns=known + null if na_position == "last" else null + known)
        by = [by] if isinstance(by, str) else list(by)
        up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
        o = self.ordered() if ignore_index else self.labelled()
        keys = []
        sdf = o.sdf
        for n, (c, a) in enumerate(zip(by, up, strict=True)):
            e = key(o.col(c)) if key else o.col(c)
            keys.append(e.asc_nulls_last() if a and na_position == "last" else e.asc_nulls_first() if a else e.desc_nulls_last() if na_position == "last" else e.desc_nulls_first())
        keys += ordered._order(o.order)
        return Sorted(o, keys, self.columns, [] if ignore_index else o.index)

    def sort_index(self, axis=0, ascending=True, na_position="last") -> Frame:
        if axis in (1, "columns"):
            return self._new(self.sdf, columns=sorted(self.columns, reverse=not ascending))
        o = self.labelled()
        return o.sort_values(o.index, ascending=ascending, na_position=na_position) if o.index != o.order or not ascending else o

    def nlargest(self, n: int, by) -> DataFrame:
        return self.sdf.orderBy(*(F.col(c).desc_nulls_last() for c in ([by] if isinstance(by, str) else by))).limit(n)

    def head(self, n=5) -> Frame:
        if n < 0:
            return self.iloc[:n]
        if not self.order:  # a source's first rows: no pass over the rest
            return self._new(self.sdf.limit(n))
        return self._new(self.sdf.orderBy(*ordered._order(self.order)).limit(n))

    def tail(self, n=5) -> Frame:
        if n < 0:
            return self.iloc[-n:]
        o = self.ordered()
        return o._new(o.sdf.orderBy(*ordered._order(o.order, descending=True)).limit(n))

    def duplicated(self, subset=None, keep="first") -> Series:
        o = self.ordered()
        keys = [subset] if isinstance(subset, str) else list(subset or self.columns)
        if keep not in ("first", "last", False):
            raise ValueError("keep must be first, last or False")
        # the row that stays is a partial aggregate of the order columns: a hot key is never gathered
        kept = o.sdf.groupBy(*(o.col(k).alias(f"__k{n}") for n, k in enumerate(keys))).agg((F.max if keep == "last" else F.min)(F.struct(*o.order)).alias("__kept"), F.count("*").alias("__n"))
        kept = store(kept, "kept")
        j = o.sdf.join(kept, [o.col(k).eqNullSafe(kept[f"__k{n}"]) for n, k in enumerate(keys)])
        flag = F.col("__n") > 1 if keep is False else F.struct(*o.order) != F.col("__kept")
        f = o._new(j.withColumn("__dup", flag).drop("__kept", "__n", *(f"__k{n}" for n in range(len(keys)))))
        return Series(f, F.col("__dup"), "duplicated")

    def drop_duplicates(self, subset=None, keep="first", ignore_index=False) -> Frame:
        s = self.duplicated(subset, keep)
        return Frame(s.frame.sdf.where(~F.col("__dup")).drop("__dup"), self.columns, [] if ignore_index else s.frame.index, s.frame.order)

    # -- 2.10 sets
    def append(self, other: Frame, ignore_index=False) -> Frame:
        return concat([self, other], ignore_index=ignore_index)

    # -- 2.11 arithmetic
    def abs(self) -> Frame:
        return self._each(lambda c: F.abs(F.col(c)), self.numeric())

    def applymap(self, func, na_action=None, dtype="double") -> Frame:
        """A function of column expressions stays in the JVM; a Python function of values runs in Arrow batches and needs ``dtype``."""
        try:
            return self._each(lambda c: _native(func, F.col(c)))
        except (TypeError, ValueError):  # it takes values, not column expressions
            one = _vector(func, spark_type(dtype), na_action)
            return self._each(lambda c: one(F.col(c)))

    # -- 2.12 reshape
    def explode(self, column, ignore_index=False) -> Frame:
        cols = [column] if isinstance(column, str) else list(column)
        o = self.ordered() if self.order else self
        if len(cols) == 1 and isinstance(self.type(cols[0]), T.ArrayType):
            sdf = o.sdf.withColumn(cols[0], F.explode_outer(cols[0]))
        else:
            arrays = [F.col(c) if isinstance(self.type(c), T.ArrayType) else F.array(F.col(c)) for c in cols]
            sdf = o.sdf.withColumn("__z", F.explode_outer(F.arrays_zip(*(a.alias(c) for a, c in zip(arrays, cols, strict=True)))))
            sdf = sdf.withColumns({c: F.col(f"__z.{n}") if f"{n}" in [f.name for f in sdf.schema["__z"].dataType.fields] else F.col(f"__z.{c}") for n, c in enumerate(cols)}).drop("__z")
        return Frame(sdf, self.columns, [] if ignore_index else o.index, o.order)

    def stack(self, dropna=True) -> Frame:
        o = self.labelled()
        place = F.create_map(*(x for n, c in enumerate(self.columns) for x in (F.lit(c), F.lit(n))))
        sdf = o.sdf.unpivot([*dict.fromkeys(o.index + o.order)], self.columns, "variable", "value")
        sdf = sdf.withColumn("__var", place[F.col("variable")])
        sdf = sdf.where(F.col("value").isNotNull()) if dropna else sdf
        return Frame(sdf, ["value"], [*o.index, "variable"], [*o.order, "__var"])

    def unstack(self, level=-1, fill_value=None, labels=None) -> Frame:
        """An index level to columns; ``labels`` names them ahead and saves a pass."""
        lev = self.index[level] if isinstance(level, int) else level
        rest = [i for i in self.index if i != lev]
        sdf = self.sdf.groupBy(*rest).pivot(lev, labels).agg(*(F.first(c).alias(c) for c in self.columns))
        sdf = sdf.na.fill(fill_value) if fill_value is not None else sdf
        return Frame(sdf, [c for c in sdf.columns if c not in rest], rest, rest)

    def pivot_table(self, values=None, index=None, columns=None, aggfunc="mean", fill_value=None, margins=False, dropna=True, margins_name="All", labels=None) -> Frame:
        as_list = lambda x: [] if x is None else [x] if isinstance(x, str) else list(x)
        index, columns = as_list(index), as_list(columns)
        values = as_list(values) or [c for c in self.numeric() if c not in index + columns]
        funcs = aggfunc if isinstance(aggfunc, dict) else {v: aggfunc for v in values}
        aggs = [self._agg(f, self.col(v)).alias(v if len(as_list(fs)) == 1 else f"{f}_{v}") for v, fs in funcs.items() for f in as_list(fs)]
        src = self.sdf.where(sum((F.col(c).isNull().cast("int") for c in index + columns), F.lit(0)) == 0)
        if margins:
            keys = index + columns
            src = src.select(*(F.col(k).cast("string").alias(f"__k{n}") for n, k in enumerate(keys)), *(c for c in src.columns if c not in keys))
            src = src.cube(*(f"__k{n}" for n in range(len(keys)))).agg(F.grouping_id().alias("__g"), *aggs)
            # all of the index or all of the columns, or neither
            i, c = (1 << len(index)) - 1, (1 << len(columns)) - 1
            src = src.where(F.col("__g").isin(0, c, i << len(columns), (i << len(columns)) | c))
            src = src.select(*(F.coalesce(f"__k{n}", F.lit(margins_name)).alias(k) for n, k in enumerate(keys)), *(F.col(f"`{a}`") for a in src.columns if not a.startswith("__")))
            aggs = [F.first(a).alias(a) for a in src.columns if a not in keys]
        if not columns:
            sdf = src if margins else src.groupBy(*index).agg(*aggs)
        else:
            on = F.concat_ws("_", *columns) if len(columns) > 1 else F.col(columns[0])
            sdf = src.withColumn("__on", on.cast("string")).groupBy(*index).pivot("__on", labels).agg(*aggs)
        data = [c for c in sdf.columns if c not in index]
        sdf = sdf.na.fill(fill_value, subset=data) if fill_value is not None else sdf
        return Frame(sdf, data, index, index)

    # -- 2.13 functions of the user
    def apply(self, func, axis=0, raw=False, result_type=None, args=(), dtype="double"):
        """axis 1: a Python function of a row, in Arrow batches.  axis 0: an aggregate by name, or a function of a column expression."""
        if isinstance(func, (str, list, dict)):
            return self.agg(func, axis)
        if axis in (1, "columns"):
            try:  # a function of a row's column expressions stays in the JVM
                return Series(self, _native(func, {c: self.col(c) for c in self.columns}, *args), "apply")
            except (TypeError, ValueError, AttributeError, KeyError):
                pass

            def rows(pdf: pd.DataFrame) -> pd.Series:
                return pd.Series([func(r if not raw else r.to_numpy(), *args) for _, r in pdf.iterrows()], index=pdf.index)

            u = F.pandas_udf(rows, spark_type(dtype))
            return Series(self, u(F.struct(*self.columns)), "apply")
        r = self.sdf.agg(*(_native(func, self.col(c), *args).alias(c) for c in self.columns)).first()
        return r.asDict()

    def pipe_pandas(self, func, schema: str) -> DataFrame:
        """A function of pandas batches over all columns."""
        return self.to_spark().mapInPandas(lambda it: map(func, it), schema)

    # -- indexers
    @property
    def iloc(self):
        return _ILoc(self)

    @property
    def loc(self):
        return _Loc(self)

    def repartition(self, n: int) -> Frame:
        return self._new(self.sdf.repartition(n if isinstance(n, int) else n[0]))


class Sorted(Frame):
    """A frame in the order of sort keys: numbered and stored when it is read whole, while ``head`` is a top-k."""

    def __init__(self, base: Frame, keys: list, columns: list[str], index: list[str]):
        self.base, self.keys, self.index, self.columns, self.order = base, keys, list(index), list(columns), ["__sorted"]

    def __getattr__(self, name):
        if name == "sdf":
            r = ordered.ranged(self.base.sdf, self.keys)
            offsets = ordered._before(r.groupBy(ordered.PART).agg(F.count("*").alias("n")), {"n": "sum"})
            at = F.row_number().over(Window.partitionBy(ordered.PART).orderBy(*self.keys)).cast("long")
            self.sdf = r.withColumn("__sorted", at).join(F.broadcast(offsets), ordered.PART).withColumn("__sorted", F.col("__sorted") - 1 + F.coalesce("__in_n", F.lit(0))).drop(ordered.PART, "__in_n")
            return self.sdf
        return super().__getattr__(name)

    def head(self, n=5) -> Frame:
        if n < 0 or "sdf" in self.__dict__:
            return super().head(n)
        top = self.base.sdf.orderBy(*self.keys).limit(n)
        return Frame(top.withColumn("__sorted", F.row_number().over(Window.orderBy(*self.keys)).cast("long") - 1), self.columns, self.index, ["__sorted"])  # a window over n rows


def _native(func, c: Column, *args) -> Column:
    out = func(c, *args)
    if not isinstance(out, Column):
        raise TypeError("not a column expression")
    return out


def _vector(func, dtype: str, na_action=None):
    @F.pandas_udf(dtype)
    def one(s: pd.Series) -> pd.Series:
        return s.map(func, na_action=na_action)

    return one


def _fits(t: T.DataType, v) -> bool:
    if isinstance(v, bool):
        return isinstance(t, T.BooleanType)
    if isinstance(v, (int, float)):
        return isinstance(t, _NUMERIC) and not isinstance(t, T.BooleanType)
    return isinstance(t, T.StringType) if isinstance(v, str) else True


def _across(how: str, cols: list[Column], skipna: bool, ddof: int) -> Column:
    """A row's aggregate."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0)) for c in cols), F.lit(0))
    if how == "sum":
        out = total
    elif how == "prod":
        out = F.lit(1)
        for c in cols:
            out = out * F.coalesce(c, F.lit(1))
    elif how == "count":
        return n
    elif how in ("max", "min"):
        out = cols[0] if len(cols) == 1 else (F.greatest if how == "max" else F.least)(*cols)
    elif how == "mean":
        out = F.try_divide(total.cast("double"), n)
    elif how in ("std", "var", "sem"):
        m = F.try_divide(total.cast("double"), n)
        v = F.when(n > ddof, sum((F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in cols), F.lit(0.0)) / (n - ddof))
        out = v if how == "var" else F.sqrt(v) if how == "std" else F.sqrt(v / n)
    elif how == "median":
        s = F.array_sort(F.array_compact(F.array(*(c.cast("double") for c in cols))))
        k = F.size(s)
        out = F.when(k > 0, (F.get(s, F.floor((k - 1) / 2).cast("int")) + F.get(s, F.floor(k / 2).cast("int"))) / 2)
    elif how in ("all", "any"):
        parts = [F.coalesce(c.cast("boolean"), F.lit(how == "all")) for c in cols]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if how == "all" else out | p
    else:
        raise ValueError(f"{how} has no form along rows")
    return out if skipna or how in ("all", "any") else F.when(n == len(cols), out)


class Series:
    """A column expression over a frame."""

    ndim = 1

    def __init__(self, frame: Frame, expr: Column, name: str | None = None):
        self.frame, self.expr, self.name = frame, expr, name

    def to_frame(self, name=None) -> Frame:
        n = name or self.name or "0"
        f = self.frame
        if n in f.index + f.order and str(self.expr) != str(F.col(n)):
            f = f.labelled()
        return Frame(f.sdf.withColumn(n, self.expr), [n], f.index, f.order)

    def _frame(self) -> Frame:
        f = self.frame
        return Frame(f.sdf.select(*(c for c in dict.fromkeys(f.index + f.order)), self.expr.alias("__v")), ["__v"], f.index, f.order)

    def _back(self, f: Frame) -> Series:
        return Series(f, F.col("__v"), self.name)

    def rename(self, name) -> Series:
        return Series(self.frame, self.expr, name)

    def to_pandas(self):
        return self._frame().to_pandas()["__v"].rename(self.name)

    def to_numpy(self, **k):
        return self.to_pandas().to_numpy(**k)

    values = property(lambda self: self.to_numpy())

    def to_list(self):
        return [r["__v"] for _, r in self._frame().iterrows()]

    tolist = to_list

    def to_dict(self):
        return {label: r["__v"] for label, r in self._frame().iterrows()}

    def items(self):
        return ((label, r["__v"]) for label, r in self._frame().iterrows())

    def __iter__(self):
        return (v for _, v in self.items())

    def __len__(self):
        return len(self.frame)

    shape = property(lambda self: (len(self),))
    size = property(lambda self: len(self))
    empty = property(lambda self: self.frame.sdf.isEmpty())
    dtype = property(lambda self: self._frame().sdf.schema["__v"].dataType.simpleString())
    index = property(lambda self: self.frame.index)

    def item(self):
        rows = self.frame.sdf.select(self.expr).head(2)
        if len(rows) != 1:
            raise ValueError("can only convert a series of one value")
        return rows[0][0]

    squeeze = lambda self, axis=None: self.item() if len(self) == 1 else self

    def __getitem__(self, key):
        if isinstance(key, Series):
            return Series(self.frame.filter(key), self.expr, self.name)
        f = self._frame()
        return self._back(f.iloc[key]) if isinstance(key, slice) else self._back(f.loc[key if isinstance(key, list) else [key]])

    def __setitem__(self, key, value) -> None:
        """By a boolean series, a label, or a list or slice as ``loc`` takes them: this object then stands for the new series."""
        f = self._frame()
        if isinstance(key, Series):
            f = Frame(self.frame.sdf.withColumn("__v", F.when(key.expr, F.lit(value)).otherwise(self.expr)), ["__v"], self.frame.index, self.frame.order)
        else:
            f = f.loc.set(key, value)
        self.frame, self.expr = f, F.col("__v")

    def stat(self, how: str, skipna=True, ddof=1, min_count=0):
        return self.frame.sdf.agg(Frame._agg(how, self.expr, ddof, min_count, skipna)).first()[0]

    def agg(self, func):
        return self.stat(func) if isinstance(func, str) else {f: self.stat(f) for f in func}

    def value_counts(self, normalize=False, sort=True, ascending=False, bins=None, dropna=True) -> Frame:
        e = self.expr
        src = self.frame.sdf
        if bins:
            lo, hi = src.agg(F.min(e), F.max(e)).first()
            width = (hi - lo) / bins or 1.0
            e = F.least(F.floor((e - lo) / width), F.lit(bins - 1)) * width + lo
        c = src.select(e.alias("value"))
        c = (c.where("value IS NOT NULL") if dropna else c).groupBy("value").agg(F.count("*").alias("count"))
        if normalize:
            total = c.agg(F.sum("count")).first()[0] or 1
            c = c.withColumn("count", F.col("count") / F.lit(float(total)))
        f = Frame(c, ["count"], ["value"], ["value"])
        return f.sort_values("count", ascending=ascending) if sort else f

    def isin(self, values):
        return Series(self.frame, scalars.isin(self.expr, values), self.name)

    def isna(self):
        return Series(self.frame, self.expr.isNull(), self.name)

    isnull = isna

    def notna(self):
        return Series(self.frame, self.expr.isNotNull(), self.name)

    def fillna(self, value=None, method=None, limit=None):
        return Series(self.frame, F.coalesce(self.expr, F.lit(value)), self.name) if method is None else self._back(self._frame().fillna(method=method, limit=limit))

    def replace(self, to_replace=None, value=None, regex=False, method=None, limit=None):
        return self._back(self._frame().replace(to_replace, value, regex, limit, method))

    def astype(self, dtype, errors="raise"):
        return Series(self.frame, self.expr.cast(spark_type(dtype)), self.name) if errors == "raise" else self._back(self._frame().astype(dtype, errors=errors))

    def abs(self):
        return Series(self.frame, F.abs(self.expr), self.name)

    def where(self, cond, other=None):
        return Series(self.frame, F.when(cond.expr, self.expr).otherwise(F.lit(other)), self.name)

    def mask(self, cond, other=None):
        return Series(self.frame, F.when(cond.expr, F.lit(other)).otherwise(self.expr), self.name)

    def apply(self, func, dtype="double", args=()):
        try:
            return Series(self.frame, _native(func, self.expr, *args), self.name)
        except (TypeError, ValueError):  # it takes values, not column expressions
            return Series(self.frame, _vector((lambda x: func(x, *args)) if args else func, spark_type(dtype))(self.expr), self.name)

    def cumsum(self, axis=None, skipna=True):
        return self._back(self._frame()._cum("sum", skipna=skipna))

    def cumprod(self, axis=None, skipna=True):
        return self._back(self._frame()._cum("prod", skipna=skipna))

    def cummin(self, axis=None, skipna=True):
        return self._back(self._frame()._cum("min", skipna=skipna))

    def cummax(self, axis=None, skipna=True):
        return self._back(self._frame()._cum("max", skipna=skipna))

    def rank(self, **k):
        return self._back(self._frame().rank(**k))

    def rolling(self, window: int, min_periods=None, center=False, win_type=None, on=None, closed=None):
        """Moving aggregates; ``win_type`` weighs the rows of a window (sum and mean), ``on`` is a column to order by."""
        s = self if on is None else Series(Frame(self.frame.sdf, self.frame.columns, self.frame.index, [on, *(c for c in self.frame.order if c != on)]), self.expr, self.name)
        return Rolling(s, window, min_periods, center, closed, win_type)

    def head(self, n=5):
        return self._back(self._frame().head(n))

    def tail(self, n=5):
        return self._back(self._frame().tail(n))

    def sort_index(self, **k):
        return self._back(self._frame().sort_index(**k))

    def duplicated(self, keep="first"):
        return self._frame().duplicated(keep=keep)

    def drop_duplicates(self, keep="first"):
        return self._back(self._frame().drop_duplicates(keep=keep))

    def explode(self, ignore_index=False):
        return self._back(self._frame().explode("__v", ignore_index))

    def reset_index(self, level=None, drop=False, name=None):
        f = self.to_frame(name).reset_index(level, drop)
        return self._back(Frame(f.sdf.withColumn("__v", F.col(f.columns[-1])), ["__v"], f.index, f.order)) if drop else f

    def dropna(self):
        return Series(self.frame.filter(self.expr.isNotNull()), self.expr, self.name)

    def unstack(self, level=-1, fill_value=None, labels=None):
        return self._frame().unstack(level, fill_value, labels)

    def groupby(self, by=None, level=None, sort=True, dropna=True):
        f = self.to_frame()
        if isinstance(by, str):
            f = Frame(f.sdf, [*f.columns, by], f.index, f.order)
        return f.groupby(by if not isinstance(by, Series) else by, level=level, sort=sort, dropna=dropna)[f.columns[0]]

    def equals(self, other) -> bool:
        return self._frame().equals(other._frame())

    def _op(self, other, op, fill=None, flip=False, level=None):
        if isinstance(other, Series) and (level is not None or other.frame.sdf is not self.frame.sdf):
            z = self._frame()._zip(other._frame(), lambda a, b: scalars.filled(op, a, b, fill), level=level)
            return self._back(z)
        b = other.expr if isinstance(other, Series) else F.lit(other)
        a, b = (b, self.expr) if flip else (self.expr, b)
        return Series(self.frame, scalars.filled(op, a, b, fill), self.name)

    def __invert__(self):
        return Series(self.frame, ~self.expr, self.name)

    def __and__(self, o):
        return self._op(o, operator.and_)

    def __or__(self, o):
        return self._op(o, operator.or_)

    __hash__ = object.__hash__


class Rolling:
    """Moving aggregates of a series over ``window`` rows."""

    #: Weights of a window's n rows, by name.
    WEIGHTS = {
        "boxcar": lambda n: [1.0] * n,
        "triang": lambda n: [1 - abs(2 * k - n + 1) / (n + n % 2) for k in range(n)],
        "bartlett": lambda n: [1 - abs(2 * k / (n - 1) - 1) if n > 1 else 1.0 for k in range(n)],
        "hann": lambda n: [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) if n > 1 else 1.0 for k in range(n)],
        "hamming": lambda n: [0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1)) if n > 1 else 1.0 for k in range(n)],
        "blackman": lambda n: [0.42 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) + 0.08 * math.cos(4 * math.pi * k / (n - 1)) if n > 1 else 1.0 for k in range(n)],
    }

    def __init__(self, series: Series, window: int, min_periods=None, center=False, closed=None, win_type=None):
        if win_type is not None and (win_type not in self.WEIGHTS or closed is not None):
            raise ValueError(f"win_type must be one of {sorted(self.WEIGHTS)}, without closed")
        self.win_type = win_type
        self.s, self.window, self.least = series, window, window if min_periods is None else min_periods
        last = (window - 1) // 2 if center else 0
        self.lo, self.hi = last - window + 1, last
        if closed == "left":
            self.lo, self.hi = self.lo - 1, self.hi - 1
        elif closed == "both":
            self.lo -= 1
        elif closed == "neither":
            self.hi -= 1

    def agg(self, how: str) -> Series:
        f = self.s._frame().ordered()

        def one(w):
            frame = w.rowsBetween(self.lo, self.hi)
            if self.win_type:
                weights = self.WEIGHTS[self.win_type](self.window)
                rows = [(x, F.lag(F.col("__v"), -k).over(w)) for x, k in zip(weights, range(self.lo, self.hi + 1), strict=True)]
                total = sum((F.coalesce(F.lit(x) * v, F.lit(0.0)) for x, v in rows), F.lit(0.0))
                if how not in ("sum", "mean"):
                    raise ValueError(f"a weighted window has no {how}")
                got = total if how == "sum" else F.try_divide(total, sum((F.when(v.isNotNull(), F.lit(x)).otherwise(0.0) for x, v in rows), F.lit(0.0)))
                return F.when(F.count(F.col("__v")).over(frame) >= self.least, got)
            f_ = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count, "median": F.median}[how]
            got = f_(F.col("__v")).over(frame)
            return got if how == "count" else F.when(F.count(F.col("__v")).over(frame) >= self.least, got)

        sdf = ordered.moving(f.sdf, f.order, {"__w": one}, max(0, -self.lo), max(0, self.hi))
        return self.s._back(Frame(sdf.withColumn("__v", F.col("__w")).drop("__w"), ["__v"], f.index, f.order))

    def __getattr__(self, how):
        if how in ("sum", "mean", "min", "max", "std", "var", "count", "median"):
            return lambda: self.agg(how)
        raise AttributeError(how)


def _values(value, cols: list[str]) -> dict[str, Column]:
    """What is set to each of ``cols``: a scalar, a series of the frame, or one of either for each column."""
    if isinstance(value, (list, tuple)):
        if len(value) != len(cols):
            raise ValueError(f"{len(value)} values for {len(cols)} columns")
        return {c: v.expr if isinstance(v, Series) else F.lit(v) for c, v in zip(cols, value, strict=True)}
    return dict.fromkeys(cols, value.expr if isinstance(value, Series) else F.lit(value))


class _ILoc:
    #: Slices that end by this position are cut from a top-k; later ones number all rows.
    TOP = 10_000

    def __init__(self, frame: Frame):
        self.f = frame

    def __setitem__(self, key, value) -> None:
        self.f._become(self.set(key, value))

    def _split(self, key):
        rows, cols = key if isinstance(key, tuple) else (key, slice(None))
        names = self.f.columns
        names = [names[cols]] if isinstance(cols, int) else names[cols] if isinstance(cols, slice) else [n for n, k in zip(names, cols, strict=True) if k] if cols and all(isinstance(k, bool) for k in cols) else [names[k] for k in cols]
        return rows, names

    def _mask(self, rows, n) -> Column:
        p = F.col("__pos")
        if isinstance(rows, bool) or not isinstance(rows, (int, slice, list, tuple)):
            raise TypeError("positions must be integers")
        if isinstance(rows, int):
            return p == (rows if rows >= 0 else n() + rows)
        if isinstance(rows, slice):
            if any(x is not None and not isinstance(x, int) for x in (rows.start, rows.stop, rows.step)):
                raise TypeError("positions must be integers")
            if all((x or 0) >= 0 for x in (rows.start, rows.stop)) and (rows.step or 1) > 0:
                lo, step = rows.start or 0, rows.step or 1
                out = (p >= lo) & ((p - lo) % step == 0)
                return out & (p < rows.stop) if rows.stop is not None else out
            r = range(*rows.indices(n()))
            return p.between(min(r, default=1), max(r, default=0)) & ((p - (r[0] if len(r) else 0)) % abs(r.step) == 0)
        if rows and all(isinstance(k, bool) for k in rows):
            rows = [i for i, k in enumerate(rows) if k]
        if any(not isinstance(k, int) for k in rows):
            raise TypeError("positions must be integers")
        return p.isin([k if k >= 0 else n() + k for k in rows])

    def __getitem__(self, key) -> Frame:
        rows, names = self._split(key)
        o = self.f.ordered()
        if isinstance(rows, slice) and rows == slice(None):
            return o._new(o.sdf, columns=names)
        narrow = o.sdf.select(*dict.fromkeys([*names, *o.index, *o.order]))
        if isinstance(rows, slice) and all(x is None or isinstance(x, int) for x in (rows.start, rows.stop, rows.step)) and 0 <= (rows.start or 0) and 0 <= (-1 if rows.stop is None else rows.stop) <= self.TOP and (rows.step or 1) > 0:
            keys = ordered._order(o.order)
            p = narrow.orderBy(*keys).limit(rows.stop)  # a top-k; then a window over its rows
            p = p.withColumn("__pos", F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)
        else:
            p = ordered.with_position(narrow, o.order)
        return o._new(p.where(self._mask(rows, p.count)), columns=names)

    def set(self, key, value) -> Frame:
        """The frame with the cells at ``key`` replaced."""
        rows, names = self._split(key)
        o = self.f.ordered()
        p = ordered.with_position(o.sdf, o.order)
        m, new = self._mask(rows, p.count), _values(value, names)
        return o._new(p.withColumns({c: F.when(m, new[c]).otherwise(F.col(c)) for c in names}))


class _Loc:
    def __init__(self, frame: Frame):
        self.f = frame

    def __setitem__(self, key, value) -> None:
        self.f._become(self.set(key, value))

    def _resolve(self, key):
        rows, cols = key if isinstance(key, tuple) else (key, slice(None))
        names = self.f.columns
        if isinstance(cols, slice):
            a = names.index(cols.start) if cols.start is not None else 0
            b = names.index(cols.stop) + 1 if cols.stop is not None else len(names)
            cols = names[a:b]
        cols = [cols] if isinstance(cols, str) else list(cols)
        rows = rows(self.f) if callable(rows) else rows
        if isinstance(rows, Series):
            return self.f, rows.expr, cols
        o = self.f.labelled()
        i = F.col(o.index[0])
        if isinstance(rows, slice):
            if rows == slice(None):
                return o, F.lit(True), cols
            # label slices include both ends: from the first row of one label to the last of the other
            p = Frame(ordered.with_position(o.sdf, o.order), o.columns, o.index, o.order)
            ends = p.sdf.agg(F.min(F.when(i == rows.start, F.col("__pos"))) if rows.start is not None else F.lit(0), F.max(F.when(i == rows.stop, F.col("__pos"))) if rows.stop is not None else F.max("__pos")).first()
            if ends[0] is None or (ends[1] is None and rows.stop is not None):
                raise KeyError(rows)
            return p, F.col("__pos").between(ends[0], -1 if ends[1] is None else ends[1]), cols
        labels = rows if isinstance(rows, list) else [rows]
        if labels and all(isinstance(x, bool) for x in labels):
            p = ordered.with_position(o.sdf, o.order)
            return Frame(p, o.columns, o.index, o.order), F.col("__pos").isin([n for n, x in enumerate(labels) if x]), cols
        found = {r[0] for r in o.sdf.where(scalars.isin(i, labels)).select(i).distinct().collect()}
        if set(labels) - found:
            raise KeyError(sorted(set(labels) - found, key=str))
        return o, scalars.isin(i, labels), cols

    def __getitem__(self, key) -> Frame:
        f, mask, cols = self._resolve(key)
        missing = [c for c in cols if c not in f.columns]
        if missing:
            raise KeyError(missing)
        return f._new(f.sdf.where(mask), columns=cols)

    def set(self, key, value) -> Frame:
        """The frame with the cells at ``key`` replaced; new columns are added."""
        f, mask, cols = self._resolve(key)
        new = {c: F.when(mask, v).otherwise(F.col(c)) if c in f.columns else F.when(mask, v) for c, v in _values(value, cols).items()}
        return f._new(f.sdf.withColumns(new), columns=f.columns + [c for c in cols if c not in f.columns])


def _operators():
    for name, op in {**scalars.BINARY, **scalars.COMPARE}.items():
        setattr(Frame, name, lambda self, other, axis=None, level=None, fill_value=None, op=op: self._binary(other, op, fill_value, axis, level))
        setattr(Series, name, lambda self, other, level=None, fill_value=None, axis=0, op=op: self._op(other, op, fill_value, level=level))
    dunder = {"add": "add", "sub": "sub", "mul": "mul", "truediv": "div", "floordiv": "floordiv", "mod": "mod", "pow": "pow", "eq": "eq", "ne": "ne", "lt": "lt", "le": "le", "gt": "gt", "ge": "ge"}
    both = {**scalars.BINARY, **scalars.COMPARE}
    for d, name in dunder.items():
        setattr(Frame, f"__{d}__", lambda self, other, op=both[name]: self._binary(other, op))
        setattr(Series, f"__{d}__", lambda self, other, op=both[name]: self._op(other, op))
        if name in scalars.BINARY:
            setattr(Series, f"__r{d}__", lambda self, other, op=both[name]: self._op(other, op, flip=True))
            setattr(Frame, f"__r{d}__", lambda self, other, op=both[name]: self._binary(other, lambda a, b, op=op: op(b, a)))
    Frame.__hash__ = object.__hash__
    for how in ("max", "min", "sum", "prod", "mean", "median", "count", "std", "var", "all", "any", "sem", "skew", "nunique"):
        setattr(Frame, how, lambda self, axis=0, how=how, **k: self.stat(how, axis, **k))
        setattr(Series, how, lambda self, axis=None, how=how, level=None, **k: self.stat(how, **k) if level is None else self.to_frame().stat(how, level=level, **k))
    Frame.product, Series.product = Frame.prod, Series.prod


_operators()


def concat(objs, axis=0, join="outer", ignore_index=False, verify_integrity=False, keys=None, names=None) -> Frame:
    """Rows of frames one after another, or their columns side by side on equal labels."""
    frames = [o.to_frame() if isinstance(o, Series) else o for o in (objs.values() if isinstance(objs, dict) else objs)]
    keys = list(objs) if isinstance(objs, dict) and keys is None else keys
    if not frames:
        raise ValueError("no objects to concatenate")
    if axis in (1, "columns"):
        out = frames[0]
        for f in frames[1:]:
            a, b = out.labelled(), f.labelled()
            left = a.sdf.select(*(F.col(i).alias(f"__i{n}") for n, i in enumerate(a.index)), *(F.col(c) for c in out.columns), F.struct(*a.order).alias("__oa"))
            right = b.sdf.select(*(F.col(i).alias(f"__j{n}") for n, i in enumerate(b.index)), *(F.col(c).alias(c if c not in out.columns else f"{c}_{len(out.columns)}") for c in f.columns), F.struct(*b.order).alias("__ob"))
            cols = out.columns + [c for c in right.columns if not c.startswith("__")]
            j = left.join(right, [left[f"__i{n}"].eqNullSafe(right[f"__j{n}"]) for n in range(len(a.index))], "full" if join == "outer" else "inner")
            out = Frame(j.select(*(F.coalesce(f"__i{n}", f"__j{n}").alias(i) for n, i in enumerate(a.index)), *cols, *map(F.expr, _ORDERED)), cols, a.index, ["__z0", "__z1", "__z2"])
        return out
    cols = list(dict.fromkeys(c for f in frames for c in f.columns)) if join == "outer" else [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    labelled = not ignore_index and (any(f.index for f in frames) or keys or verify_integrity)
    parts = []
    for n, f in enumerate(frames):
        f = f.labelled() if labelled else f
        one = f.sdf.select(*(F.col(c) for c in cols if c in f.columns), *((F.col(i).alias(f"__i{k}") for k, i in enumerate(f.index)) if labelled else ()), F.lit(n).alias("__src"))
        parts.append(one.withColumn("key", F.lit(keys[n])) if keys else one)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    index = (["key"] if keys else []) + [c for c in out.columns if c.startswith("__i")]
    if verify_integrity and not out.groupBy(*index).count().where("count > 1").isEmpty():
        raise ValueError("indexes have overlapping values")
    if labelled:
        return Frame(out, cols, index, ["__src", *[i for i in index if i != "key"]])
    return Frame(out, cols, [], [])
