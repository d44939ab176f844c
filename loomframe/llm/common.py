"""What several operators share: durable intermediate tables and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one is set only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_loomframe_scratch", None)
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = sc._loomframe_scratch = "file://" + tempfile.mkdtemp(prefix="loomframe-")
    root = f"{root.rstrip('/')}/loomframe-{sc.applicationId}"
    if not getattr(sc, "_loomframe_doomed", False):  # what is still read at the end goes with the driver's JVM
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        sc._loomframe_doomed = True
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomframe_path = path
    return out


def by_bytes(batches, limit: int = 1 << 21):
    """The rows of ``batches`` in slices of some ``limit`` bytes, a row at least: what a worker turns to objects at once."""
    for b in batches:
        rows = max(1, len(b) * limit // max(1, b.nbytes))
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` lacks, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"_{base}{i}") not in taken)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_loomframe_path", None)
        if path:
            spark = t.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) on a table of (larger, smaller) edges.
    A hub's edges are never gathered: minima are partial aggregates, and the joins read two stored tables, so
    that adaptive execution can split a hub's partition.  Self links and links with a null end are ignored;
    repeated links count once; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    kind = edges.schema[a].dataType
    e = edges.select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = materialize(e, "cc")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.unionAll(low2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        release(e, low, large, low2)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
