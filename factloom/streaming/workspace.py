"""A workspace that is looked at again and again: each look is a micro-batch of a stream.

A batch lists the folder, holds it against the snapshot of the batch before and stores the
differences and its own snapshot under its number. A batch that runs again after a failure
writes the same places, and a stream that starts again from its checkpoint goes on with the
next number, so no change is told twice or lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delta import snapshot_diff
from ..sources.files import scanned

SNAPSHOT = "path string, fingerprint string"
CHANGES = "batch long, path string, status string"


def _place(out: str, kind: str, batch: int) -> str:
    return f"{out}/{kind}/batch={batch}"


def look(spark: SparkSession, folder: str, out: str, batch: int) -> None:
    """One look: the snapshot of a batch, and its differences to the one before."""
    scanned(spark, folder).select("path", "fingerprint").write.mode("overwrite").parquet(_place(out, "snapshots", batch))
    now = spark.read.schema(SNAPSHOT).parquet(_place(out, "snapshots", batch))
    before = spark.read.schema(SNAPSHOT).parquet(_place(out, "snapshots", batch - 1)) if batch else now.where(F.lit(False))
    snapshot_diff(before, now, "path", "fingerprint").write.mode("overwrite").parquet(_place(out, "changes", batch))
    # The last snapshot stays for a batch that runs again; those before it are done with.
    old = spark._jvm.org.apache.hadoop.fs.Path(_place(out, "snapshots", batch - 2))
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def polled(spark: SparkSession, folder: str, out: str, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Starts the stream: a look at ``folder`` every so often, changes under ``out``."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def run(_: DataFrame, batch: int) -> None:
        look(spark, folder, out, batch)

    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def changes(spark: SparkSession, out: str) -> DataFrame:
    """(batch, path, status) of all looks so far."""
    return spark.read.schema(CHANGES).parquet(f"{out}/changes").select("batch", "path", "status")
