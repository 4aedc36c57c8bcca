"""Joins in which a key may hold a large share of all rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which on it is dealt out.
HOT = 200_000


def hot_keys(df: DataFrame, key: str, more_than: int | None = None) -> list:
    """The keys of more rows than the bound; at most as many as the table has such shares."""
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (HOT if more_than is None else more_than))
    return [r[0] for r in found.select(key).collect()]


def lanes(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner", parts: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` by a column of both. Rows of ``left`` with a hot key are dealt
    out by their hash, and ``right``, which has few rows of each key, is repeated for them.
    ``parts`` is the number of partitions, where the session's is not to set it.

    Neither side is broadcast: loops would leave a table in the driver's memory for every step."""
    if not hot:
        return _merged(left, right, [key], how, parts)
    n = lanes(left)
    return _merged(_in_lanes(left, key, hot, n), _for_lanes(right, key, hot, n), [key, "_lane"], how, parts).drop("_lane")


def _in_lanes(left: DataFrame, key: str, hot: list, n: int) -> DataFrame:
    dealt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*left.columns), F.lit(n)))
    return left.withColumn("_lane", dealt.otherwise(F.lit(0).cast("long")))


def _for_lanes(right: DataFrame, key: str, hot: list, n: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    copies = F.when(F.col(key).isin(hot), F.sequence(zero, F.lit(n - 1).cast("long"))).otherwise(F.array(zero))
    return right.withColumn("_lane", F.explode(copies))


class Dealt:
    """A table that a loop joins by one column again and again: dealt out and sorted once, kept
    on the executors (memory, then disk), and taken anew from what is below it where one is lost.

    Only the other side of a join is shuffled. ``done`` gives the room back; no result may still need it."""

    def __init__(self, df: DataFrame, key: str, parts: int):
        self.key, self.hot, self._n = key, hot_keys(df, key), lanes(df)
        keys = [key, "_lane"] if self.hot else [key]
        rows = _in_lanes(df, key, self.hot, self._n) if self.hot else df
        self._keys, self._rows = keys, rows.repartition(parts, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)

    def join(self, right: DataFrame, how: str = "inner") -> DataFrame:
        many = _for_lanes(right, self.key, self.hot, self._n) if self.hot else right
        return self._rows.join(many.hint("merge"), self._keys, how).drop("_lane")

    def done(self) -> None:
        self._rows.unpersist()


def _merged(left: DataFrame, right: DataFrame, keys: list[str], how: str, parts: int | None) -> DataFrame:
    if not parts:
        return left.join(right.hint("merge"), keys, how)
    # Of two bare repartitions a join makes ones by the session's number; below new names one stays, and the other side follows it.
    names = {c: f"_left_{c}" for c in left.columns if c not in keys}
    dealt = left.repartition(parts, *keys).select(*keys, *[F.col(c).alias(n) for c, n in names.items()])
    return dealt.join(right.hint("merge"), keys, how).withColumnsRenamed({n: c for c, n in names.items()})
