"""Seeded k-means: oversampled candidates, weighted k-means++ among them, Lloyd's steps by partial sums.

Draws are hashes of a row's id, so a run doesn't depend on partitions. Only centres (k of them,
or a few times k candidates) and one sum a centre and dimension pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of oversampling, and candidates expected a round as a multiple of k.
ROUNDS, OVER = 5, 2.0


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres, summed in the order of the values."""
    out = np.zeros((len(x), len(centres)))
    for k in range(x.shape[1]):
        out += (x[:, k, None] - centres[:, k]) ** 2
    return out


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, vector) with ``cluster``, the place of the nearest centre (the first of equals), and ``square``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _squares(np.stack(batch["vector"].to_numpy()).astype("f8"), centres)
                cluster = d.argmin(1)
                yield batch.assign(cluster=cluster.astype("i4"), square=d[np.arange(len(d)), cluster])

    return rows.select("id", "vector").mapInPandas(run, "id long, vector array<double>, cluster int, square double")


def lloyd(rows: DataFrame, centres: np.ndarray, steps: int = 25) -> np.ndarray:
    """Centres after so many steps, fewer where nothing moves. A centre without rows stays."""
    for _ in range(steps):
        means = assigned(rows, centres).select("cluster", F.posexplode("vector").alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("mean")).collect()
        after = centres.copy()
        for r in means:
            after[r.cluster, r.k] = r.mean
        if (after == centres).all():
            break
        centres = after
    return centres


def _uniform(seed: int, draw: int) -> Column:
    """A number between 0 and 1 that an id and a draw give."""
    return (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(draw)), 11) + 0.5) / F.lit(float(1 << 53))


def initial_centres(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """k distinct starting centres, or fewer if there are fewer vectors.

    Each round takes rows with a chance by their squared distance to what was taken so far;
    the candidates, weighted by the rows nearest to each, are thinned out by k-means++.
    """
    rows = rows.select("id", F.col("vector").cast("array<double>").alias("vector"))
    first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    taken = np.array([first[0].vector])
    for draw in range(ROUNDS):
        near = assigned(rows, taken)
        total = near.agg(F.sum("square")).first()[0]
        if not total:
            break
        new = near.where(_uniform(seed, draw) < F.least(F.lit(1.0), F.lit(OVER * k / total) * F.col("square"))).select("vector").collect()
        taken = np.unique(np.concatenate([taken, np.array([r.vector for r in new]).reshape(-1, taken.shape[1])]), axis=0)
    weight = np.zeros(len(taken))
    for r in assigned(rows, taken).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect():
        weight[r.cluster] = r.n
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(taken)):
        chance = _squares(taken, taken[chosen]).min(1) * weight
        if not chance.sum():
            break
        chosen.append(int(rng.choice(len(taken), p=chance / chance.sum())))
    return taken[chosen]


def clusters(rows: DataFrame, k: int, seed: int = 1, steps: int = 25) -> DataFrame:
    """(id, cluster, square) of rows (id, vector); clusters are numbered in the order of their centres' values."""
    rows = rows.where("vector is not null")
    centres = initial_centres(rows, k, seed)
    if not len(centres):
        return rows.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("cluster"), F.lit(0.0).alias("square")).where(F.lit(False))
    centres = lloyd(rows, centres, steps)
    return assigned(rows, centres[np.lexsort(centres.T[::-1])]).select("id", "cluster", "square")
