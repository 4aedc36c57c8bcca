"""What the operators of this folder share: tables, the shared folder, files, blocks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files under a frame that ``stored`` made, once nothing reads it."""
    spark = df.sparkSession
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes behind ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def put_file(uri: str, data: bytes) -> None:
    """Writes a file whole: under a name of its own first, then renamed.

    A second attempt of a lost task writes the same bytes and replaces the file.
    """
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)


def get_file(uri: str) -> bytes:
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as src:
        return src.read()


def open_file(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def blocks(
    batches: Iterable[pa.RecordBatch], max_chars: int, max_rows: int = 60_000
) -> Iterator[tuple[list, list[str]]]:
    """Joins a partition's (id, text) rows into blocks of bounded size; null text is empty.

    A text longer than ``max_chars`` makes a block alone.
    """
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = t or ""
            if ids and (size + len(t) > max_chars or len(ids) >= max_rows):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


def pieces(texts: list, chars: int) -> Iterator[slice]:
    """Slices of a list of texts of about so many characters each."""
    k = 0
    while k < len(texts):
        n, size = k, 0
        while n < len(texts) and (n == k or size + len(texts[n] or "") <= chars):
            size += len(texts[n] or "")
            n += 1
        yield slice(k, n)
        k = n


_HELD: dict = {}


def held(name: tuple, make: Callable[[], object]):
    """What a Python worker keeps between tasks; those of another operator drop it."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def begin(owner: str) -> None:
    """A task of an operator begins in this worker.

    Of the module, not of the function below: that one travels by value, with copies of what it names.
    """
    if _HELD.get("owner") != owner:
        _HELD.clear()
        _HELD["owner"] = owner


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that leaves little behind, as its worker lives on for other stages.

    Arrow's memory comes from the C library, and what is free goes back when the task ends.
    """

    owner = run.__module__

    def wrapped(batches: Iterator) -> Iterator:
        begin(owner)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    """Hands freed memory back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as no column of ``df`` begins with, whatever its case."""
    taken = [c.lower() for c in df.columns]
    return [n + "_" * sum(c.startswith(n.lower()) for c in taken) for n in names]


def attempt() -> str:
    """A part of a file's name that no other attempt of a task has; only files that a finished attempt lists count."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId():08d}" if task else uuid.uuid4().hex[:12]


def crc32(data: bytes, start: int = 0) -> int:
    return zlib.crc32(data, start) & 0xFFFFFFFF


def tokenizer_path(name: str) -> str:
    """Default place of a public tokenizer's file; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
