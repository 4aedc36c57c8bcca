"""Populations, archives and small aggregates over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

from .pareto import crowding, frontier


def merged(first: DataFrame, second: DataFrame, key: str = "uid") -> DataFrame:
    """Union of two populations; of a key in both, the first's row."""
    return first.unionByName(second.join(first.select(key), key, "left_anti")).dropDuplicates([key])


def twins_replaced(archive: DataFrame, candidates: DataFrame, axes: list[str], key: str = "uid", tolerance: float = 1e-9) -> DataFrame:
    """``archive`` and ``candidates``, without archive rows that a candidate equals within the tolerance.

    Cells of the tolerance's width, and their neighbours, limit what is compared.
    """
    cells = {f"_c{k}": F.floor(F.col(a) / tolerance) for k, a in enumerate(axes)}
    near = candidates.select(*axes).withColumns(cells)
    for c in cells:
        near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    near = near.select(*[F.col(a).alias(f"_n_{a}") for a in axes], *cells)
    close = reduce(lambda x, y: x & y, [F.abs(F.col(a) - F.col(f"_n_{a}")) <= tolerance for a in axes])
    gone = archive.withColumns(cells).join(near, list(cells)).where(close).select(key).distinct()
    return archive.join(gone, key, "left_anti").unionByName(candidates)


def archived(archive: DataFrame, candidates: DataFrame, axes: list[str], objectives: list[str], capacity: int, key: str = "uid") -> DataFrame:
    """The archive after candidates: twins replaced, the frontier (maximized) of what there is, and of more than ``capacity`` the least crowded."""
    return _least_crowded(frontier(twins_replaced(archive, candidates, axes, key), objectives, minimize=False), objectives, capacity, key)


def elites(population: DataFrame, archive: DataFrame, objectives: list[str], capacity: int, key: str = "uid") -> DataFrame:
    """The frontier (maximized) of a population and the archive's other members, the least crowded ``capacity`` of it."""
    return _least_crowded(frontier(merged(population, archive, key), objectives, minimize=False), objectives, capacity, key)


def _least_crowded(front: DataFrame, objectives: list[str], capacity: int, key: str) -> DataFrame:
    rows = crowding(front.withColumn("_front", F.lit(0)), objectives, "_front", key)
    return rows.orderBy(F.desc("crowding"), key).limit(capacity).select(*front.columns)


def survivors(evaluated: DataFrame, size: int, threshold: float = 2.0, key: str = "uid") -> DataFrame:
    """The best ``size`` of (key, status, speed_gain) by gain; reverted ones, and losses of more than the threshold, are out."""
    rows = evaluated.where((F.col("status") != "REVERTED") & (F.col("speed_gain") >= -threshold))
    return rows.orderBy(F.desc("speed_gain"), key).limit(size)


def seed_objectives(coverage: Column, anomalies: Column, targets: Column, wall: Column, code_tokens: Column, comment_tokens: Column) -> Column:
    """Struct of ``score`` and three ``rows`` of (accuracy, seconds, compression) to start a population from."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    share = number(anomalies) / F.greatest(F.coalesce(targets.cast("long"), F.lit(0)), F.lit(1))
    accuracy = F.greatest(F.lit(0.0), number(coverage) * (1 - F.least(F.lit(1.0), share) * 0.5))
    code = F.when(number(code_tokens) > 0, number(code_tokens)).otherwise(1.0)
    compression = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - number(comment_tokens) / code))
    row = lambda a, w, c: F.array(a, w, c)
    return F.struct(
        F.round(accuracy, 6).alias("score"),
        F.array(
            row(accuracy, number(wall), compression),
            row(F.greatest(F.lit(0.0), accuracy * 0.99), number(wall) * 1.05, compression),
            row(F.least(F.lit(1.0), accuracy * 1.01), number(wall) * 0.95, F.least(F.lit(1.0), compression * 1.01)),
        ).alias("rows"),
    )


def anomaly_ratio(anomalies: Column, failures: Column, ceiling: Column, fallback_ceiling: Column) -> Column:
    """The larger count over the first ceiling that is not 0; 0 without one."""
    most = F.greatest(F.coalesce(anomalies, F.lit(0)), F.coalesce(failures, F.lit(0)))
    limit = F.coalesce(F.nullif(ceiling, F.lit(0)), fallback_ceiling, F.lit(0))
    return F.when(limit > 0, most / limit).otherwise(0.0)


def tournament(population: DataFrame, rounds: int, size: int, key: str, order: list[Column], seed: int = 0) -> DataFrame:
    """(round, winner): the best of ``size`` members that a hash draws for each round, ties by key.

    A member's draw in a round is the hash of seed, round and key. Only draws under a bound, which
    about four times ``size`` members of a round pass, leave the scan; rounds in which fewer than
    ``size`` pass are drawn again without it.
    """
    count = population.count()
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col(key).cast("string")))
    share = min(1.0, (4 * size + 40) / max(count, 1))
    bound = f"{int(share * 0xFFFFFFFF):08x}"

    def drawn(of: DataFrame, first: bool) -> DataFrame:
        some = of.withColumn("_draw", draw)
        some = some.where(F.substring("_draw", 1, 8) <= bound) if first and share < 1 else some
        return some.withColumn("_k", F.row_number().over(Window.partitionBy("round").orderBy("_draw", key))).where(F.col("_k") <= size)

    every = population.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    some = drawn(every, True)
    if share < 1:
        some = kept(some)
        full = {r["round"] for r in some.groupBy("round").count().where(F.col("count") == size).collect()}  # one row a round
        few = [k for k in range(rounds) if k not in full]
        if few:
            some = some.where(~F.col("round").isin(few)).unionByName(drawn(every.where(F.col("round").isin(few)), False))
    best = F.row_number().over(Window.partitionBy("round").orderBy(*order, key))
    return some.withColumn("_b", best).where("_b = 1").select("round", F.col(key).alias("winner"))


def clamped(value: Column, low: float, high: float, kind: str) -> Column:
    """A parameter within its bounds, as its type: whole numbers are rounded to even."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), value.cast("double")))
    return F.bround(inside).cast("long") if kind == "int" else inside


def snapped(value: Column, choices: Column, default: Column) -> Column:
    """A categorical value, or the default if it isn't among the choices, or the first of them if neither is; without choices it stays."""
    none = choices.isNull() | (F.size(choices) == 0)
    return F.when(none | F.array_contains(choices, value), value).when(F.array_contains(choices, default), default).otherwise(F.get(choices, F.lit(0)))


def sampled(parameters: DataFrame, seed: int, count: int) -> DataFrame:
    """(member, name, value): values of (name, low, high, kind), and of ``choices`` where there are any, drawn by a hash of member and name."""
    rows = parameters.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("member").cast("string"), "name"))
    u = F.conv(F.substring(draw, 1, 10), 16, 10).cast("double") / float(1 << 40)
    value = F.col("low") + u * (F.col("high") - F.col("low"))
    value = F.when(F.col("kind") == "int", F.bround(value)).otherwise(value)
    if "choices" in parameters.columns:
        value = F.when(F.size("choices") > 0, F.get("choices", F.floor(u * F.size("choices")).cast("int"))).otherwise(value)
    return rows.select("member", "name", value.alias("value"))


def blended(build: Column, runtime: dict[str, Column], weight: float) -> Column:
    """A map of objectives with weighted runtime ones added; null ones are left out."""
    extra = F.map_filter(F.create_map(*[x for k, v in runtime.items() for x in (F.lit(k), v * weight)]), lambda _, v: v.isNotNull())
    kept = F.map_filter(build, lambda k, _: ~k.isin(list(runtime)))
    return F.map_concat(kept, extra)


def consensus(matrices: DataFrame) -> DataFrame:
    """Mean Frobenius norm of sparse matrices (g, i, j, w)."""
    norms = matrices.groupBy("g").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return norms.agg(F.avg("norm").alias("consensus"))


def cache_statistics(log: DataFrame) -> DataFrame:
    """Hits, misses, rate and entries of an access log (key, hit)."""
    row = log.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.countDistinct("key").alias("entries"))
    return row.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def successor_conflicts(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(parent, child, left_next, right_next): triples new on both sides with different successors."""
    new = lambda side, n: side.exceptAll(base).distinct().withColumnRenamed("next", n)
    both = new(left, "left_next").join(new(right, "right_next"), ["parent", "child"])
    return both.where(~F.col("left_next").eqNullSafe(F.col("right_next")))


def launch_edges(sites: DataFrame, kernels: DataFrame) -> DataFrame:
    """(site, kernel) where a site (site, name, text) calls a kernel by name, or its text launches one with ``name <<<``."""
    by_name = sites.join(kernels, sites["name"] == kernels["kernel"]).select("site", "kernel")
    found = sites.select("site", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)\s*<<<"), F.lit(1))).alias("kernel")).join(kernels, "kernel").select("site", "kernel")
    return by_name.unionByName(found).distinct()
