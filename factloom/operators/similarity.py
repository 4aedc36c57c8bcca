"""Neighbours, similar pairs, and selections of trajectories."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .skew import hot_keys, lanes, spread_join

#: Rows of a key from which on the pairs of it are dealt out.
PAIRED = 2_000
#: Features of profiles that may be ranked by their frequency, a list that goes to all tasks.
RANKED = 200_000
#: Masks of 64 bits of the features that follow one; all of two profiles meet by chance the more rarely.
MASKS = 3
#: Pairs of points for each task of a join by cells, and most tasks.
TASK_PAIRS, MOST_TASKS = 20_000_000, 20_000
#: Probes that one pass may hold as a broadcast; more go in several passes.
PROBES = 2_000

Metric = Callable[[Column, Column], Column]


def padded(vector: Column, size: int) -> Column:
    """A vector of doubles of exactly ``size`` values: zeros are added, and what is more is cut."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(1.0)


def squared(a: Column, b: Column) -> Column:
    """Squared distance in the vectors' own type, exact for three decimals."""
    part = lambda k: (F.get(a, F.lit(k)) - F.get(b, F.lit(k))) * (F.get(a, F.lit(k)) - F.get(b, F.lit(k)))
    return part(0) + part(1) + part(2)


#: Distances by name; those of ``KERNELS`` have a form over blocks of vectors as well.
METRICS: dict[str, Metric] = {"euclidean": euclidean, "cosine": cosine_distance, "decimal": squared}
KERNELS = ("euclidean", "cosine")


def _sequential(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of terms over the last axis, in the order of the values, so that equal vectors have equal sums."""
    total = np.zeros(a.shape[:-1])
    for k in range(a.shape[-1]):
        total = total + term(a[..., k], b[..., k])
    return total


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(_sequential(a, b, lambda x, y: (x - y) * (x - y)))
    product = lambda x, y: _sequential(x, y, lambda u, v: u * v)
    size = np.sqrt(product(a, a)) * np.sqrt(product(b, b))
    return np.where(size > 0, 1 - product(a, b) / np.where(size > 0, size, 1.0), 1.0)


def _quick(metric: str, rows: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Distances by a matrix product, near enough to leave out what is far."""
    if metric == "euclidean":
        return np.sqrt(np.maximum((rows * rows).sum(1)[:, None] + (probes * probes).sum(1) - 2 * rows @ probes.T, 0.0))
    size = np.sqrt((rows * rows).sum(1))[:, None] * np.sqrt((probes * probes).sum(1))
    return np.where(size > 0, 1 - rows @ probes.T / np.where(size > 0, size, 1.0), 1.0)


def _near(names: list, vectors: np.ndarray, k: int, metric: str):
    """The k nearest rows of a task for each probe: by quick distances first, decided by exact ones."""

    def best(probe: np.ndarray, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        order = np.lexsort((ids, far, probe))
        first = np.flatnonzero(np.concatenate([[True], np.diff(probe[order]) > 0]))
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        return order[nth < k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe, ids, far = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        for batch in batches:
            for x in range(0, len(batch), 1000):
                some = batch.iloc[x : x + 1000]
                rows = np.stack(some["vector"].to_numpy()).astype("f8")
                quick = _quick(metric, rows, vectors)
                bound = np.partition(quick, min(k, len(rows)) - 1, axis=0)[min(k, len(rows)) - 1]
                slack = 1e-6 * (1 + np.abs(bound) + np.sqrt((vectors * vectors).sum(1)))
                r, p = np.nonzero(quick <= bound + slack)
                probe, ids = np.concatenate([probe, p]), np.concatenate([ids, some["id"].to_numpy("i8")[r]])
                far = np.concatenate([far, _exact(metric, rows[r], vectors[p])])
                keep = best(probe, ids, far)
                probe, ids, far = probe[keep], ids[keep], far[keep]
        yield pd.DataFrame({"probe": np.array(names, "i8")[probe], "id": ids, "distance": far})

    return run


def nearest(rows: DataFrame, probes: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """The k nearest rows of (id, vector) for each probe of (probe, vector), exactly; ties by id.

    The probes are a stated set against all rows, in blocks of at most ``PROBES`` that go to all
    tasks; each task hands on k rows a probe. A metric that is a function of two columns is
    worked out by a join instead.
    """
    count = probes.count()
    blocks = max(1, -(-count // PROBES))
    out = None
    for b in range(blocks):
        some = probes if blocks == 1 else probes.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == b)
        some = some.select("probe", F.col("vector").alias("probe_vector"))
        if metric in KERNELS:
            held = some.collect()  # PROBES rows or so
            if not held:
                continue
            run = _near([r.probe for r in held], np.array([r.probe_vector for r in held], "f8"), k, metric)
            near = rows.select(F.col("id").cast("long").alias("id"), "vector").mapInPandas(run, "probe long, id long, distance double")
        else:
            near = rows.join(F.broadcast(some), F.lit(True)).select("probe", "id", METRICS[metric](F.col("vector"), F.col("probe_vector")).alias("distance"))
        rank = F.row_number().over(Window.partitionBy("probe").orderBy("distance", "id"))
        part = near.withColumn("rank", rank).where(F.col("rank") <= k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "probe long, id long, distance double, rank int")


def similar_pairs(profiles: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, similarity) with a < b of sparse profiles (id, feature, value) with cosine of ``cutoff`` or more.

    The product is a join on the feature, so pairs without one in common never meet. Features
    have one order, the most frequent ones last. At a pair's first common feature the rest of both
    profiles bounds their cosine by the product of its lengths (Cauchy-Schwarz), so only features
    with a rest of ``cutoff`` or more are joined. There the product of both values is known, and what
    comes after it adds nothing where masks of the features that follow have no bit in common,
    else the product of their lengths at most; only pairs that may reach the cutoff leave their task,
    to be added up. Similarities count as they are rounded to six digits, so half of the last digit less is enough.

    Profiles that are dealt out by id already are shuffled once only, by feature.
    """
    least = cutoff - 5e-7 - 1e-9
    own = profiles.where("id is not null and value <> 0").withColumn("norm", F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id"))))
    own = own.where("feature is not null and norm > 0").select("id", "feature", (F.col("value") / F.col("norm")).alias("u"))
    often, floor = _frequent(profiles)
    ranked = own.join(F.broadcast(often), "feature", "left").select("id", "feature", "u", F.coalesce("df", F.lit(0)).alias("df"))
    if floor == 1:  # what isn't in the list is in one profile
        ranked = ranked.where("df > 0")
    # From the last feature on, so that sums run along.
    w = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("feature"))
    later = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum(F.col("u") * F.col("u")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.coalesce(F.sum(F.col("u") * F.col("u")).over(later), F.lit(0.0))
    bit = lambda k: F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(feature), {16 * k}), 64) AS int))")
    masks = [F.coalesce(F.bit_or(bit(k)).over(later), F.lit(0).cast("long")).alias(f"m{k}") for k in range(MASKS)]
    heads = ranked.select("id", "feature", "u", F.sqrt(after).alias("after"), *masks, F.sqrt(rest).alias("rest")).where(F.col("rest") >= least).drop("rest")
    # A feature of many heads is dealt out, so that no task has all its pairs.
    hot = hot_keys(heads, "feature", PAIRED) if often.where(F.col("df") > PAIRED).take(1) or floor > PAIRED else []
    if hot:
        names = {c: f"{c}_2" for c in heads.columns if c != "feature"}
        met = spread_join(heads, heads.withColumnsRenamed(names), "feature", hot)
        col = lambda side, c: F.col(c if side == "l" else names[c])
    else:  # both sides are one shuffle
        met = heads.alias("l").join(heads.alias("r").hint("merge"), "feature")
        col = lambda side, c: F.col(f"{side}.{c}")
    common = reduce(lambda x, y: x & y, [col("l", m).bitwiseAND(col("r", m)) != 0 for m in (f"m{k}" for k in range(MASKS))])
    most = col("l", "u") * col("r", "u") + F.when(common, col("l", "after") * col("r", "after")).otherwise(0.0)
    candidates = met.where((col("l", "id") < col("r", "id")) & (most >= least)).select(col("l", "id").alias("a"), col("r", "id").alias("b")).distinct()
    # Both profiles of a pair come by one join.
    ends = candidates.withColumn("id", F.explode(F.array("a", "b")))
    both = ends.join(own, "id").repartition("a", "b").groupBy("a", "b", "feature")
    side = lambda c: F.sum(F.when(F.col("id") == F.col(c), F.col("u")))
    sums = both.agg((side("a") * side("b")).alias("part")).groupBy("a", "b").agg(F.sum("part").alias("similarity"))
    return sums.withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= cutoff)


def _frequent(profiles: DataFrame) -> tuple[DataFrame, int]:
    """(feature, df) of the most frequent features, at most ``RANKED``, and the most profiles that any other is in."""
    often = profiles.where("value <> 0 and feature is not null").groupBy("feature").agg(F.count("*").alias("df")).where("df > 1")
    often = kept(often)
    # A row for each number of digits.
    levels = sorted(often.groupBy(F.length(F.bin("df")).alias("digits")).count().collect(), reverse=True)
    floor, total = 1, 0
    for r in levels:
        total += r["count"]
        if total > RANKED:
            floor = 2**r.digits - 1
            break
    return often.where(F.col("df") > floor), floor


def close_pairs(points: DataFrame, axes: list[str], radius: float) -> DataFrame:
    """(a, b, distance) with a < b of points (id, axes) nearer than ``radius``.

    Points are dealt out by cells of that width; each looks into its own and the next cells.
    """
    cell = {f"_c{k}": F.floor(F.col(a) / radius) for k, a in enumerate(axes)}
    here = points.withColumns(cell)
    near = points.withColumns(cell)
    for k in range(len(axes)):
        near = near.withColumn(f"_c{k}", F.explode(F.array(F.col(f"_c{k}") - 1, F.col(f"_c{k}"), F.col(f"_c{k}") + 1)))
    near = near.select(F.col("id").alias("b"), *[F.col(a).alias(f"_{a}") for a in axes], *cell)
    place = F.concat_ws("|", *[F.col(c).cast("string") for c in cell])
    left = here.withColumnRenamed("id", "a").withColumn("_cell", place).drop(*cell)
    right = near.withColumn("_cell", place).drop(*cell)
    # Few bytes make many pairs: tasks are counted by these, and a cell of many points is dealt out over lanes.
    count = left.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    pairs = count.agg(F.sum(F.col("_n") * F.col("_n") * 3 ** len(axes))).first()[0] or 0
    tasks = int(min(max(pairs // TASK_PAIRS + 1, lanes(points)), MOST_TASKS))
    dealt = F.least(F.ceil(F.col("_n") / PAIRED), F.lit(tasks))
    count = kept(count.select("_cell", dealt.alias("_lanes")))
    # Numbered by hand, so that tasks stay as many whatever their bytes.
    left = left.join(count.hint("merge"), "_cell").withColumn("_lane", F.pmod(F.xxhash64("a"), F.col("_lanes")))
    right = right.join(count.hint("merge"), "_cell").withColumn("_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lanes") - 1)))
    keys = ["_cell", "_lane"]
    both = left.drop("_lanes").repartition(tasks, *keys).join(right.drop("_lanes").repartition(tasks, *keys).hint("shuffle_hash"), keys).where("a < b")
    distance = F.sqrt(reduce(lambda x, y: x + y, [F.pow(F.col(a) - F.col(f"_{a}"), 2) for a in axes]))
    return both.select("a", "b", distance.alias("distance")).where(F.col("distance") < radius)


def top(trajectories: DataFrame, count: int, action: str | None = None) -> DataFrame:
    """The best ``count`` by result, of one action if it is named; ties by id."""
    rows = trajectories if action is None else trajectories.where(F.col("action") == action)
    return rows.orderBy(F.desc("result"), "id").limit(count)


def bounded(trajectories: DataFrame, size: int = 200) -> DataFrame:
    """What a bounded replay keeps; results that are null or not finite are rejected."""
    finite = F.col("result").isNotNull() & ~F.isnan("result") & ~F.col("result").isin(float("inf"), float("-inf"))
    return top(trajectories.where(finite), size)


def best_matrices(trajectories: DataFrame, count: int) -> DataFrame:
    """The best non-empty parameters among the first 4 * count rows; it may give fewer."""
    return top(trajectories, 4 * count).where(F.size("params") > 0).orderBy(F.desc("result"), "id").limit(count)


def state_similarity(numbers: Column, probe_numbers: dict[str, float], texts: Column, probe_texts: dict[str, str]) -> Column:
    """Mean closeness over shared keys: numbers by their relative difference, texts by equality; 0 without any."""
    n = [(F.try_element_at(numbers, F.lit(k)), F.lit(float(v))) for k, v in probe_numbers.items()]
    t = [(F.try_element_at(texts, F.lit(k)), F.lit(v)) for k, v in probe_texts.items()]
    close = [F.when(a.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))) for a, b in n]
    same = [F.when(a == b, 1.0).otherwise(0.0) for a, b in t]
    shared = [F.when(a.isNotNull(), 1).otherwise(0) for a, _ in n + t]
    total, count = reduce(lambda x, y: x + y, close + same), reduce(lambda x, y: x + y, shared)
    return F.when(count > 0, total / count).otherwise(0.0)


def cluster_weights(fitness: DataFrame) -> DataFrame:
    """(cluster, weight): mean fitness of (cluster, fitness), shifted to 0 and normalised; even if all are equal."""
    means = fitness.groupBy("cluster").agg(F.avg("fitness").alias("m"))
    span = means.agg(F.min("m").alias("lo"), F.sum("m").alias("sum"), F.count("*").alias("n"))
    rows = means.crossJoin(F.broadcast(span))  # one row
    total = F.col("sum") - F.col("n") * F.col("lo")
    return rows.select("cluster", F.when(total > 1e-12, (F.col("m") - F.col("lo")) / total).otherwise(1 / F.col("n")).alias("weight"))


def affinity(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, score): sum over centroids (cluster, vector, weight), a bounded set, of weight / (1 + distance)."""
    both = rows.join(F.broadcast(centroids.select("weight", F.col("vector").alias("centre"))), F.lit(True))
    return both.groupBy("id").agg(F.sum(F.col("weight") / (1 + euclidean(F.col("vector"), F.col("centre")))).alias("score"))
