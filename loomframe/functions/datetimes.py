"""Parsing and ranges of timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Strftime codes and Spark's letters for them.
CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%I": "hh", "%z": "xx", "%Z": "z"}
UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}
# Frequency letters and SQL interval units.
FREQ = {"D": "DAY", "H": "HOUR", "h": "HOUR", "T": "MINUTE", "min": "MINUTE", "S": "SECOND", "s": "SECOND", "W": "WEEK", "MS": "MONTH", "M": "MONTH", "ME": "MONTH", "YS": "YEAR", "AS": "YEAR", "Y": "YEAR", "YE": "YEAR", "Q": "QUARTER", "QS": "QUARTER", "B": "DAY"}


def spark_format(fmt: str) -> str:
    parts = re.split(r"(%[A-Za-z])", fmt)
    return "".join(CODES[p] if p in CODES else re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", p) for p in parts)


def to_datetime(c: Column, format: str | None = None, errors: str = "raise", unit: str | None = None, origin: str = "unix", dayfirst: bool = False, yearfirst: bool = False) -> Column:
    """Timestamps from text, or from numbers of ``unit`` since ``origin``.  errors: raise, or coerce to NULL; ignore leaves the column."""
    if errors == "ignore":
        return c
    if unit is not None:
        base = F.lit("1970-01-01" if origin == "unix" else str(origin)).cast("timestamp_ntz")
        exact, scale = c.cast("decimal(28,6)"), {"D": 86_400, "h": 3_600, "m": 60}.get(unit)
        micros = exact * (scale * 1_000_000) if scale else exact * 1_000_000 / UNITS[unit]
        return F.timestamp_add("MICROSECOND", micros.cast("long"), base)
    if format is None and (dayfirst or yearfirst):
        format = "%d/%m/%Y" if dayfirst else "%Y/%m/%d"
    if format is None:
        return F.try_to_timestamp(c).cast("timestamp_ntz") if errors == "coerce" else c.cast("timestamp_ntz")
    f = F.lit(spark_format(format))
    return (F.try_to_timestamp(c, f) if errors == "coerce" else F.to_timestamp(c, spark_format(format))).cast("timestamp_ntz")


def interval(freq: str) -> tuple[int, str]:
    m = re.fullmatch(r"(-?\d*)([A-Za-z]+)", freq)
    if not m or m[2] not in FREQ:
        raise ValueError(f"unknown frequency {freq}")
    return int(m[1] or 1), FREQ[m[2]]


def date_range(spark: SparkSession, start: str | None = None, end: str | None = None, periods: int | None = None, freq: str = "D", name: str = "d", closed: str | None = None, normalize: bool = False) -> DataFrame:
    """Regular timestamps; two of start, end and periods.  Month, quarter and year ends for M, Q and Y; business days for B."""
    n, unit = interval(freq)
    if sum(x is not None for x in (start, end, periods)) != 2:
        raise ValueError("of start, end and periods, exactly two must be given")
    if unit == "QUARTER":
        n, unit = 3 * n, "MONTH"
    step = f"INTERVAL '{n}' {unit}"
    point = lambda s: f"TIMESTAMP_NTZ '{s}'"
    lo = point(start) if start is not None else f"({point(end)} - {periods - 1} * {step})"
    hi = point(end) if end is not None else f"({point(start)} + {max(periods - 1, 0)} * {step})"
    if normalize:
        lo, hi = f"CAST(date_trunc('DAY', {lo}) AS TIMESTAMP_NTZ)", f"CAST(date_trunc('DAY', {hi}) AS TIMESTAMP_NTZ)"
    df = spark.sql(f"SELECT explode(sequence({lo}, {hi}, {step})) AS `{name}`")
    c = F.col(name)
    if freq.lstrip("-0123456789") in ("M", "ME"):
        df = df.select(F.last_day(c).cast("timestamp_ntz").alias(name))
    elif freq.lstrip("-0123456789") in ("Y", "YE"):
        df = df.select(F.make_date(F.year(c), F.lit(12), F.lit(31)).cast("timestamp_ntz").alias(name))
    elif freq.lstrip("-0123456789") == "B":
        df = df.where(F.dayofweek(c).between(2, 6))
    if closed == "left":
        df = df.where(c < F.expr(hi))
    elif closed == "right":
        df = df.where(c > F.expr(lo))
    if periods == 0:
        df = df.where(F.lit(False))
    return df
