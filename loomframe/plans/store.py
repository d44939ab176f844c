"""Durable intermediate tables and plan reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The session's own folder under ``spark.checkpoint.dir``; a local one only where Spark is one process.  It goes with the driver's JVM."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_loomframe_scratch", None)
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = sc._loomframe_scratch = "file://" + tempfile.mkdtemp(prefix="loomframe-")
    root = f"{root.rstrip('/')}/loomframe-{sc.applicationId}"
    if not getattr(sc, "_loomframe_doomed", False):
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        sc._loomframe_doomed = True
    return root


def store(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the folder of ``scratch`` and read it again."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text: simple, extended, cost, codegen or formatted."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
