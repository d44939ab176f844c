"""Hand-off of results to training processes: equal, contiguous shards in a shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import with_position
from ..operators.frame import Frame


def shard(frame: Frame, num_shards: int, full_batch: bool = False) -> DataFrame:
    """Rows with ``__pos`` and ``shard``: contiguous equal parts, or all rows for each shard.  The length must divide evenly."""
    o = frame.ordered()
    p = with_position(o.sdf.select(*o._keep()), o.order)
    if full_batch:
        return p.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(num_shards - 1))))
    n = p.count()
    if n % num_shards:
        raise ValueError(f"{n} rows don't divide into {num_shards} shards")
    return p.withColumn("shard", F.floor(F.col("__pos") / max(1, n // num_shards)).cast("int"))


class DataSender:
    """Writes each batch sent as a folder of shards; ``max_queue_size`` unread batches at most."""

    def __init__(self, path: str, num_shards: int = 1, full_batch: bool = False, max_queue_size: int = 10):
        self.path, self.num_shards, self.full_batch, self.most, self.sent = path, num_shards, full_batch, max_queue_size, 0

    def send(self, frame: Frame) -> None:
        out = shard(frame, self.num_shards, self.full_batch)
        if self.sent - _read_mark(out.sparkSession, self.path) >= self.most:
            raise RuntimeError("the queue is full")
        out.write.partitionBy("shard").parquet(f"{self.path}/batch={self.sent}")
        self.sent += 1

    def stream(self, sdf: DataFrame, checkpoint: str):
        """The micro-batches of a stream, each one batch of the channel."""
        return sdf.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: b.withColumn("shard", F.pmod(F.xxhash64(*b.columns), F.lit(self.num_shards)).cast("int")).write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/batch={i}")).start()


class DataReceiver:
    def __init__(self, spark: SparkSession, path: str, shard_id: int = 0):
        self.spark, self.path, self.shard_id, self.at = spark, path, shard_id, 0

    def peek(self) -> DataFrame:
        """The next batch's rows of this shard, in order; raises if it isn't there yet."""
        sdf = self.spark.read.parquet(f"{self.path}/batch={self.at}").where(F.col("shard") == self.shard_id)
        return sdf.orderBy("__pos").drop("__pos", "shard") if "__pos" in sdf.columns else sdf.drop("shard")

    def recv(self) -> DataFrame:
        out = self.peek()
        self.at += 1
        if self.shard_id == 0:
            _mark(self.spark, self.path, self.at)
        return out


def _fs(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_mark(spark, path) -> int:
    n = 0
    fs, _ = _fs(spark, path)
    while fs.exists(_fs(spark, f"{path}/read={n + 1}")[1]):
        n += 1
    return n


def _mark(spark, path, n) -> None:
    fs, p = _fs(spark, f"{path}/read={n}")
    fs.mkdirs(p)
