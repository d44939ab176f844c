"""Sources of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import Frame, Series


def read_parquet(spark: SparkSession, path: str, columns=None, order=()) -> Frame:
    sdf = spark.read.parquet(path)
    return Frame(sdf.select(*columns) if columns else sdf, order=order)


def read_csv(spark: SparkSession, path: str, sep=",", header="infer", names=None, index_col=None, usecols=None, dtype=None, nrows=None, skiprows=0, na_values=None, quotechar='"', escapechar="\\", comment=None, encoding="utf-8", schema=None, multiline=False, order=()) -> Frame:
    """CSV files, split by Spark; types from ``schema``, else inferred from all rows.  Compressed files and folders are read alike."""
    r = spark.read.option("sep", sep).option("quote", quotechar).option("escape", escapechar).option("encoding", encoding).option("multiLine", multiline)
    r = r.option("header", header in ("infer", 0, True) and names is None or header == 0)
    if comment:
        r = r.option("comment", comment)
    if na_values is not None:
        r = r.option("nullValue", na_values if isinstance(na_values, str) else na_values[0])
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    if skiprows:  # lines, ahead of the header; quoted line ends aren't looked into
        text = spark.read.option("encoding", encoding).text(path).withColumn("__at", F.monotonically_increasing_id())
        first = [x["__at"] for x in text.orderBy("__at").select("__at").head(skiprows)]
        text = text.where(~F.col("__at").isin(first)).select("value")
        lines = getattr(text._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        sdf = DataFrame(r._jreader.csv(lines), spark)
    else:
        sdf = r.csv(path)
    if names is not None:
        sdf = sdf.toDF(*names)
    if usecols is not None:
        sdf = sdf.select(*(sdf.columns[c] if isinstance(c, int) else c for c in usecols))
    f = Frame(sdf, order=order)
    if nrows is not None:
        f = f.iloc[:nrows]
    if dtype is not None:
        f = f.astype(dtype)
    if index_col is not None:
        f = f.set_index([f.columns[c] if isinstance(c, int) else c for c in ([index_col] if not isinstance(index_col, list) else index_col)])
    return f


def read_feather(spark: SparkSession, path: str, columns=None) -> Frame:
    """An Arrow IPC file, by way of the driver; for files that fit there."""
    from pyarrow import feather

    return from_arrow(spark, feather.read_table(path, columns=columns))


def from_arrow(spark: SparkSession, table) -> Frame:
    return from_spark(spark.createDataFrame(table))


def from_pandas(spark: SparkSession, pdf, order=()) -> Frame:
    """A local frame; its labels become the index unless they are positions; NaN and NaT become NULL."""
    import pandas as pd

    plain = isinstance(pdf.index, pd.RangeIndex) and pdf.index.start == 0 and pdf.index.step == 1
    names = [] if plain else [str(n) if n is not None else f"level_{i}" for i, n in enumerate(pdf.index.names)]
    out = pdf.rename(columns=lambda c: "_".join(map(str, c)) if isinstance(c, tuple) else str(c))
    data = list(out.columns)
    out = (out if plain else out.rename_axis(names).reset_index()).assign(__ord=range(len(out)))
    import pyarrow as pa

    sdf = spark.createDataFrame(pa.Table.from_pandas(out, preserve_index=False))
    return Frame(sdf, data, names, list(order) or ["__ord"])


def from_numpy(spark: SparkSession, array, columns=None) -> Frame:
    import pandas as pd

    return from_pandas(spark, pd.DataFrame(array, columns=columns))


def from_dict(spark: SparkSession, data: dict, index=None) -> Frame:
    import pandas as pd

    return from_pandas(spark, pd.DataFrame(data, index=index))


def series(spark: SparkSession, data, index=None, name="0") -> Series:
    import pandas as pd

    return from_pandas(spark, pd.Series(data, index=index, name=name).to_frame())[str(name)]


def from_spark(sdf: DataFrame, index=(), order=()) -> Frame:
    return Frame(sdf, [c for c in sdf.columns if c not in index], list(index), list(order))
