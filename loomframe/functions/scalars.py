"""Element-wise expressions with the reference's meaning of nulls, signs and zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column, dtype: str) -> Column:
    """NaN becomes NULL, for floating types."""
    return F.nanvl(c, F.lit(None).cast(dtype)) if dtype in ("double", "float") else c


def eq(a, b):
    return F.coalesce(a == b, F.lit(False))


def ne(a, b):
    return F.coalesce(a != b, F.lit(True))


def lt(a, b):
    return F.coalesce(a < b, F.lit(False))


def le(a, b):
    return F.coalesce(a <= b, F.lit(False))


def gt(a, b):
    return F.coalesce(a > b, F.lit(False))


def ge(a, b):
    return F.coalesce(a >= b, F.lit(False))


def add(a, b):
    return a + b


def sub(a, b):
    return a - b


def mul(a, b):
    return a * b


def div(a, b):
    """True division; NULL for a zero divisor."""
    return F.try_divide(a, b)


def floordiv(a, b):
    return F.floor(F.try_divide(a, b))


def mod(a, b):
    """The remainder with the divisor's sign."""
    return a - b * F.floor(F.try_divide(a, b))


def power(a, b):
    return F.pow(a, b)


BINARY = {"add": add, "sub": sub, "mul": mul, "div": div, "truediv": div, "floordiv": floordiv, "mod": mod, "pow": power}
COMPARE = {"eq": eq, "ne": ne, "lt": lt, "le": le, "gt": gt, "ge": ge}


def filled(op, a, b, fill=None):
    """``op`` with a fill value for one null side; NULL where both are null."""
    if fill is None:
        return op(a, b)
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(op(F.coalesce(a, F.lit(fill)), F.coalesce(b, F.lit(fill))))


def skew(c: Column) -> Column:
    """Bias-corrected skewness; NULL under three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def isin(c: Column, values) -> Column:
    values = list(values.keys() if isinstance(values, dict) else values)
    has_null = any(v is None or v != v for v in values)
    some = [v for v in values if v is not None and v == v]
    hit = F.coalesce(c.isin(some), F.lit(False)) if some else F.lit(False)
    return hit | c.isNull() if has_null else hit


#: Aggregates by name, over a column without NaN.
AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "count": F.count,
    "size": lambda c: F.count(F.lit(1)),
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "median": F.median,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "skew": skew,
    "nunique": F.count_distinct,
    "all": lambda c: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
    "any": lambda c: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
}
NUMERIC_ONLY = frozenset("prod mean median std var sem skew".split())
