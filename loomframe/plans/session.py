"""Session settings under the names that users of the reference's configuration calls know."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

#: Rewrite rules that can be switched off, by the name of what they rewrite.
RULES = {
    "filter_pushdown": "org.apache.spark.sql.catalyst.optimizer.PushDownPredicates",
    "column_pruning": "org.apache.spark.sql.catalyst.optimizer.ColumnPruning",
    "projection_fusion": "org.apache.spark.sql.catalyst.optimizer.CollapseProject",
    "constant_folding": "org.apache.spark.sql.catalyst.optimizer.ConstantFolding",
    "join_reorder": "org.apache.spark.sql.catalyst.optimizer.CostBasedJoinReorder",
}

_PARTITIONS = "spark.sql.shuffle.partitions"
#: The shape last set, and the number of partitions that Spark had then.
_SHAPE = "spark.loomframe.partitionShape"


def session(app: str = "loomframe", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and nanosecond-free timestamps."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def set_concurrency_mode(spark: SparkSession, mode: str, **_) -> None:
    """Accepted for compatibility: threads and processes are the master's choice."""
    if mode not in ("multithread", "multiprocess"):
        raise ValueError("mode must be multithread or multiprocess")


def get_concurrency_mode(spark: SparkSession) -> str:
    return "multithread" if spark.sparkContext.master.startswith("local[") else "multiprocess"


def set_partition_shape(spark: SparkSession, shape: tuple[int, int]) -> None:
    """Row blocks become shuffle partitions; column blocks have no counterpart, but are kept for the getter."""
    if len(shape) != 2 or min(shape) < 1:
        raise ValueError("shape must be two positive integers")
    spark.conf.set(_PARTITIONS, str(shape[0]))
    spark.conf.set(_SHAPE, f"{shape[0]},{shape[1]},{spark.conf.get(_PARTITIONS)}")


def get_partition_shape(spark: SparkSession) -> tuple[int, int]:
    """The shape last set, also where a deployment holds Spark's number of partitions; Spark's own where it has changed since."""
    now = int(spark.conf.get(_PARTITIONS))
    rows, columns, then = map(int, spark.conf.get(_SHAPE, f"{now},1,{now}").split(","))
    return (rows, columns) if then == now else (now, 1)


def set_min_block_size(spark: SparkSession, size: int) -> None:
    if size < 1:
        raise ValueError("size must be positive")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", str(size))


def set_adaptive_concurrency(spark: SparkSession, adaptive: bool) -> None:
    spark.conf.set("spark.sql.adaptive.enabled", str(bool(adaptive)).lower())


def get_min_block_size(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def get_adaptive_concurrency(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.adaptive.enabled") == "true"


def get_process_mode(spark: SparkSession) -> str:
    return "local" if spark.sparkContext.master.startswith("local") else "cluster"


def set_lazy_mode(flag: bool) -> None:
    """Plans are always lazy."""


_TIMED: dict[str, list[float]] = {}
_BENCHMARK = False


def set_benchmark_mode(flag: bool) -> None:
    """While set, ``timed`` runs its plan to the end, so that its seconds are the plan's own."""
    global _BENCHMARK
    _BENCHMARK = bool(flag)


def get_benchmark_mode() -> bool:
    return _BENCHMARK


def timed(name: str, df: DataFrame) -> DataFrame:
    """``df``; in benchmark mode it is run first, and its seconds are kept for ``snapshot``."""
    if _BENCHMARK:
        start = time.perf_counter()
        benchmark(df)
        _TIMED.setdefault(name, []).append(time.perf_counter() - start)
    return df


def snapshot(reset: bool = False) -> dict[str, dict[str, float]]:
    """Runs, total and mean seconds of what ``timed`` has run, by name."""
    out = {n: {"runs": len(t), "total": sum(t), "mean": sum(t) / len(t)} for n, t in _TIMED.items()}
    if reset:
        _TIMED.clear()
    return out


def benchmark(df: DataFrame) -> None:
    """Run a plan to the end and drop its rows."""
    df.write.format("noop").mode("overwrite").save()


def disable(spark: SparkSession, *rules: str) -> None:
    off = {x for x in (spark.conf.get("spark.sql.optimizer.excludedRules", "") or "").split(",") if x}
    spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(sorted(off | {RULES.get(r, r) for r in rules})))


def enable(spark: SparkSession, *rules: str) -> None:
    off = {x for x in (spark.conf.get("spark.sql.optimizer.excludedRules", "") or "").split(",") if x}
    spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(sorted(off - {RULES.get(r, r) for r in rules})))
