"""Baselines, anomalies, correlations, and series of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Change and second change below which a score stands still, and for how long.
VELOCITY_EPSILON, ACCELERATION_EPSILON, PATIENCE = 0.005, 0.005, 15


def unpivoted(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*ids, F.inline(pairs))


def baseline(values: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric; a single value has deviation 1."""
    return values.groupBy("metric").agg(F.avg("value").alias("mean"), F.when(F.count("value") == 1, 1.0).otherwise(F.stddev_samp("value")).alias("stdev"), F.count("value").alias("n"))


def zscore_anomalies(values: DataFrame, stats: DataFrame, threshold: float = 2.5, inverted: tuple[str, ...] = ()) -> DataFrame:
    """Values beyond the threshold: above it, or below it for inverted metrics.

    ``stats`` has a row for each metric, a bounded set that goes to all tasks: joined by a shuffle, all
    values of a metric would be one task's. Metrics without spread give none.
    """
    z = (F.col("value") - F.col("mean")) / F.col("stdev")
    rows = values.join(F.broadcast(stats.where("stdev >= 1e-9")), "metric").withColumn("zscore", z)
    beyond = F.when(F.col("metric").isin(list(inverted)), F.col("zscore") < -threshold).otherwise(F.col("zscore") > threshold)
    severity = F.when(F.abs("zscore") > 2 * threshold, "critical").otherwise("warning")
    return rows.where(beyond).withColumn("severity", severity)


def most_anomalous(anomalies: DataFrame, ceiling: int, tie: list[str]) -> DataFrame:
    """The ``ceiling`` anomalies of largest absolute z."""
    return anomalies.orderBy(F.desc(F.abs("zscore")), *tie).limit(ceiling)


def anomaly_ceiling(files: Column, configured: int = 0) -> Column:
    """At least 50, or a twentieth of the files."""
    return F.greatest(F.lit(50), F.floor(files * 0.05).cast("int"), F.lit(configured), F.lit(1))


def importance(df: DataFrame, parameters: list[str], gain: str) -> DataFrame:
    """Absolute correlation of each parameter with the gain; 0 where there are 20 rows or fewer."""
    row = df.agg(F.count("*").alias("n"), *[F.corr(p, gain).alias(p) for p in parameters])
    value = lambda p: F.when((F.col("n") > 20) & ~F.isnan(F.coalesce(F.col(p), F.lit(float("nan")))), F.abs(p)).otherwise(0.0)
    return row.select(F.inline(F.array(*[F.struct(F.lit(p).alias("parameter"), value(p).alias("importance")) for p in parameters])))


def drift(base: DataFrame, current: DataFrame, limit: float = 0.3) -> DataFrame:
    """(key, base, current, drift, exceeds): relative change by key of (key, value); a base of 0 counts as 1."""
    both = base.select("key", F.col("value").alias("base")).join(current.select("key", F.col("value").alias("current")), "key", "full_outer")
    change = F.abs(F.coalesce("current", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))) / F.abs(F.when(F.coalesce("base", F.lit(0.0)) == 0, 1.0).otherwise(F.col("base")))
    return both.withColumn("drift", change).withColumn("exceeds", F.col("drift") > limit)


def kinetics(scores: DataFrame, series: str, order: list[str], score: str) -> DataFrame:
    """Velocity, acceleration and the length of the stall so far of each series.

    A step stalls if from the third score on both changes are small. Scores that are null
    or not finite count as 0. A run ends where a step moves, so its length is the number of
    steps since the last that did.
    """
    w = Window.partitionBy(series).orderBy(*order)
    value = F.when(F.col(score).isNull() | F.isnan(score) | F.col(score).isin(float("inf"), float("-inf")), 0.0).otherwise(F.col(score).cast("double"))
    rows = scores.withColumn("_v", value).withColumn("step", F.row_number().over(w))
    rows = rows.withColumns({"_b": F.lag("_v", 1).over(w), "_c": F.lag("_v", 2).over(w)})
    velocity = F.coalesce(F.col("_v") - F.col("_b"), F.lit(0.0))
    acceleration = F.when(F.col("step") >= 3, velocity - (F.col("_b") - F.col("_c"))).otherwise(0.0)
    rows = rows.withColumns({"velocity": velocity, "acceleration": acceleration})
    stalls = (F.col("step") >= 3) & (F.abs("velocity") < VELOCITY_EPSILON) & (F.abs("acceleration") < ACCELERATION_EPSILON)
    rows = rows.withColumn("_moved", F.max(F.when(~stalls, F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stall = (F.col("step") - F.coalesce("_moved", F.lit(0))).cast("long")
    return rows.withColumns({"stall": stall, "stagnant": stall >= PATIENCE}).drop("_v", "_b", "_c", "_moved")


def moving_average(series: DataFrame, key: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """(key, n, ema): the last exponential moving average of each series, from 0; null where a value is.

    A value counts by its distance from the end, so a series is numbered from there and added up.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(value))) - 1
    weighted = F.lit(alpha) * F.pow(F.lit(1 - alpha), back.cast("double")) * F.col(value).cast("double")
    rows = series.select(F.col(key), F.col(value).alias("_v"), weighted.alias("_w"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("_v") == F.count("*"), F.sum("_w")).alias("ema"))


def without_improvement(series: DataFrame, key: str, order: list[str], value: str, least: float = 0.0) -> DataFrame:
    """Steps since the last value above the best before it by more than ``least``."""
    w = Window.partitionBy(key).orderBy(*order)
    best = F.coalesce(F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = series.withColumn("step", F.row_number().over(w)).withColumn("improved", F.col(value) > best + least)
    last = F.max(F.when(F.col("improved"), F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("idle", (F.col("step") - F.coalesce(last, F.lit(0))).cast("long"))
