"""Session helpers: reading tables, and making the package known to Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes of an Arrow batch, where the session doesn't say otherwise: whole texts travel in them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine has none (tests, notebooks) a temporary folder becomes it;
    on a cluster that is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ranges(df: DataFrame, parts: int, keys: list[str]) -> DataFrame:
    """``df`` in exactly so many partitions by ranges of the keys, each sorted."""
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


#: Rows that one task sorts or gathers in steps that set their number of partitions.
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: their number grows with the rows, not what one task holds."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def ship(spark: SparkSession) -> None:
    """Adds the package to the files that executors get, once an application, and bounds Arrow batches."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
