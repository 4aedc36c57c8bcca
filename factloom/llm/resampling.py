"""Importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Words and word pairs are hashed to ``buckets``. Two bag-of-buckets models are counted, of
all text and of target text (documents that a label marks as good). A document's log
weight is the log of the models' ratio, the sum of its n-grams' log ratios. With ``length``
it is instead their mean times that, which leaves a text's length out. Sampling without replacement in proportion to the weights takes the k largest
of log weight plus Gumbel noise, the noise drawn from a hash of the id.

The k-th key is found exactly without a sort: the range that holds it is narrowed by
histograms until it holds one key; ties at that key go by the smaller id, then text hash.

Defined results: null text is empty, and an empty text has log weight 0; a null id draws
the noise of the text alone; without any labelled row all weights are 0 and the keep share
is ``keep`` or 1; repeated rows are kept or left as one; an empty table gives an empty
result. Labels with conflicting or null values count as they stand; null is no target.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, frugal, stored, table
from .words import Words

_SPLIT = re.compile(r"\w+|[^\w\s]")


def _grams(words: Words, text: str, buckets: int) -> np.ndarray:
    """Bucket of each word and each pair of words that follow each other."""
    h = words.hashes(_SPLIT.findall(text.lower()))
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([h, pair]) >> np.uint64(11)) % np.uint64(buckets)


def _counts(buckets: int):
    schema = pa.schema([("target", pa.bool_()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), {False: np.zeros(buckets, "<i8"), True: np.zeros(buckets, "<i8")}
        for goods, texts in blocks(batches, 2_000_000):
            for good, text in zip(goods, texts, strict=True):
                n = np.bincount(_grams(words, text, buckets).astype("i8"), minlength=buckets)
                sums[False] += n
                if good:
                    sums[True] += n
        for target, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), target)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], schema=schema)

    return run


def _scores(ratio: np.ndarray, length: float | None):
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("log_weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                g = _grams(words, text or "", len(ratio)).astype("i8")
                out.append(float(ratio[g].sum() if length is None else length * ratio[g].mean()) if len(g) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64())], schema=schema)

    return run


def log_ratios(docs: DataFrame, buckets: int, smoothing: float) -> np.ndarray:
    """Log of target over raw probability of each bucket, from (target, text) of all rows."""
    rows = docs.mapInArrow(frugal(_counts(buckets)), "target boolean, bucket int, n long").groupBy("target", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, buckets))
    for target, bucket, n in rows.collect():  # 2 * buckets rows at most
        counts[int(target), bucket] = n
    if not counts[1].any():
        return np.zeros(buckets)
    p = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def kth_largest(keys: DataFrame, k: int, bins: int = 2048) -> float:
    """The k-th largest of the column ``key`` (1 <= k <= rows), exactly."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        at = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        inside = keys.where((F.col("key") >= F.lit(lo)) & (F.col("key") <= F.lit(hi)))
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # bins rows at most
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return hi


def importance_resample(
    docs: DataFrame, labels: DataFrame, keep: float | None = None, buckets: int = 10_000, smoothing: float = 1.0, length: float | None = None, seed: int = 13
) -> DataFrame:
    """The sample: (doc_id, log_weight, gumbel_key) of the k documents drawn from ``docs``.

    ``keep`` is the share of rows to draw, by default the share of labelled rows that are
    of target kind; k is that share of the rows, rounded.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("g")).distinct()
    if keep is None:
        share = labels.agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
        keep = 1.0 if share is None else share
    # A shuffle at every size: labels grow with the documents, and a text is moved once.
    marked = rows.join(good.hint("merge"), F.col("id") == F.col("g"), "left").select(F.col("g").isNotNull().alias("target"), "text")
    ratio = log_ratios(marked, buckets, smoothing)
    scored = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).select("id", "text", "tie").mapInArrow(frugal(_scores(ratio, length)), "doc_id long, tie long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", "tie")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = stored(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "resample-keys")
    total = keyed.count()
    k = round(total * keep)
    if not k:
        return keyed.where(F.lit(False)).drop("tie")
    edge = kth_largest(keyed.select(F.col("gumbel_key").alias("key")), k)
    sure = keyed.where(F.col("gumbel_key") > F.lit(edge))
    tied = keyed.where(F.col("gumbel_key") == F.lit(edge)).orderBy(F.col("doc_id").asc_nulls_last(), "tie").limit(k - sure.count())
    return sure.unionByName(tied).drop("tie")


def op3_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
