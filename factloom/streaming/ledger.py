"""Ledgers, weights and caches that grow with a stream, trigger by trigger.

Each writer takes a micro-batch and its number, as ``foreachBatch`` gives them. A batch that
comes again after a failure replaces its own files and so changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import invalidated
from ..operators.ledger import chained


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _before(spark: SparkSession, path: str, epoch: int, schema: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).where(F.col("epoch") < epoch)


LEDGER = "chain string, t_causal long, prev_hash string, payload string, block_hash string, epoch long"


def ledger_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Appends (chain, seq, payload) to each chain behind its last block."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        tail = _before(spark, path, epoch, LEDGER).groupBy("chain").agg(F.max_by("block_hash", "t_causal").alias("tail"), (F.max("t_causal") + 1).alias("next"))
        blocks = chained(batch, "chain", "seq", "payload", tail)
        blocks.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


WEIGHTS = "signature string, weight long, epoch long"


def weight_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Adds the visits of each signature; the sum over epochs is its weight."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("signature").agg(F.count("*").alias("weight")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("signature").agg(F.sum("weight").alias("weight"))


def cache_writer(path: str, edges: DataFrame) -> Callable[[DataFrame, int], None]:
    """Applies changes (key, fingerprint) to a cache of (key, fingerprint) with its dependants.

    Each trigger writes a whole new version, read from the one before.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = spark.read.parquet(f"{path}/{epoch - 1}") if _exists(spark, f"{path}/{epoch - 1}") else spark.createDataFrame([], "key string, fingerprint string")
        latest = batch.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("fingerprint")))).where("k = 1").drop("k")
        left = invalidated(now, edges, latest)
        left.unionByName(latest.join(left.select("key"), "key", "left_anti")).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return write
