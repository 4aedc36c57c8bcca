"""Fronts and volumes over many ranges against brute force."""

import numpy as np
import pytest

from factloom.operators import pareto


def _peeled(x):
    front, left, k = np.full(len(x), -1), np.arange(len(x)), 0
    while len(left):
        own = x[left]
        free = ~np.array([((own <= p).all(1) & (own < p).any(1)).any() for p in own])
        front[left[free]] = k
        left, k = left[~free], k + 1
    return front


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_fronts_over_ranges(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.integers(0, 12, (250, dims)), rng.integers(0, 60, (250, dims))]).astype(float)
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "id long, " + ", ".join(f"c{k} double" for k in range(dims)))
    want = _peeled(x)
    for block in (40, 100_000):
        got = {r.id: r.front for r in pareto.fronts(df, [f"c{k}" for k in range(dims)], block=block).collect()}
        assert [got[k] for k in range(len(x))] == want.tolist()


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_fronts_of_few_cells_are_no_chain_of_ranges(spark, monkeypatch, dims):
    def by_turns(*_):
        raise AssertionError("a range waits for the one before")

    monkeypatch.setattr(pareto, "_bases", by_turns)
    rng = np.random.default_rng(10 + dims)
    x = rng.integers(0, 5, (600, dims)).astype(float)
    x[:, dims // 2] = rng.integers(-90, 90, 600)  # the one of many values isn't always the first
    rows = [(k, *map(float, p)) for k, p in enumerate(x)] + [(600, *[None] * dims)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"c{k} double" for k in range(dims)))
    for minimize, last in ((True, np.inf), (False, 0.0)):
        want = _peeled(np.concatenate([x, np.full((1, dims), last)]) * (1 if minimize else -1))
        got = {r.id: r.front for r in pareto.fronts(df, [f"c{k}" for k in range(dims)], minimize, block=25).collect()}
        assert [got[k] for k in range(601)] == want.tolist()


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_frontier_that_stays_large(spark, monkeypatch, dims):
    monkeypatch.setattr(pareto, "LAST", 60)
    rng = np.random.default_rng(dims)
    x = rng.integers(1, 400, (600, dims)).astype(float)
    x[:, -1] = 1000 - x[:, :-1].sum(1) + (rng.random(600) < 0.05)  # on a plane, but for a few above
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "id long, " + ", ".join(f"c{k} double" for k in range(dims)))
    got = {r.id for r in pareto.frontier(df.repartition(6), [f"c{k}" for k in range(dims)]).collect()}
    assert got == {k for k, f in enumerate(_peeled(x)) if f == 0}


def test_many_points_on_a_front_in_one_task():
    rng = np.random.default_rng(3)
    x = rng.random((50_000, 3))
    x[:, 2] = 2 - x[:, 0] - x[:, 1]
    assert len(pareto._front(x)) == 50_000


def test_volume_of_groups_over_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [(g, *map(float, rng.integers(-2, 9, 3))) for g in (1, 2, None) for _ in range(120)] + [(7, -1.0, 5.0, 5.0)] + [(8, float(k), 9.0 - k, 1.0) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double")
    got = {r.g: r.hypervolume for r in pareto.hypervolume_3d(df.repartition(5), ("x", "y", "z"), (0.0, 0.0, 0.0), "g").collect()}
    for g in (1, 2, None, 7, 8):
        cells = np.zeros((9, 9, 9), bool)
        for _, x, y, z in (r for r in rows if r[0] == g):
            cells[: int(max(x, 0)), : int(max(y, 0)), : int(max(z, 0))] = True
        assert got[g] == cells.sum()
