"""Components, waves, cycles and halves against plain graph code."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from factloom import session
from factloom.operators import components as C
from factloom.operators import skew


def _reach(edges, nodes):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            out[a] = out[a] | out[b]
    return out


def _random(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("hot", [200_000, 3])
def test_strong_components(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT", hot)
    rng = random.Random(1)
    # Many graphs side by side: random ones, rings of mixed numbers, a path, an edge to itself, a hub.
    shapes = [_random(rng, 30, 45), [(k, (k * 7 + 3) % 41) for k in range(41)] + [(0, 100)], [(k, k + 1) for k in range(12)], [(5, 5), (5, 6)], [(0, k) for k in range(1, 9)] + [(k, 0) for k in range(4, 9)]]
    whole = [(200 * k + a, 200 * k + b) for k, edges in enumerate(shapes) for a, b in edges]
    for edges in [whole]:
        nodes = sorted({x for e in edges for x in e})
        reach = _reach(edges, nodes)
        want = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
        frame = spark.createDataFrame(edges + [(None, 1)], "src long, dst long")
        parts = C.strong_components(frame)
        assert {r.node: r.component for r in parts.collect()} == want
        between = {(r.src, r.dst) for r in C.condensed(frame.where("src is not null"), parts).collect()}
        assert between == {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    assert C.strong_components(frame.where("src > 1000")).count() == 0


def test_waves_with_cycles(spark):
    rng = random.Random(2)
    for edges in (_random(rng, 25, 30), [(1, 2), (2, 3), (1, 3)]):
        waiting = {x: {a for a, b in edges if b == x} for e in edges for x in e}
        want, k = {}, 0
        while waiting:
            ready = [n for n, v in waiting.items() if not v & set(waiting)] or list(waiting)
            want.update((n, k) for n in ready)
            waiting, k = {n: v for n, v in waiting.items() if n not in ready}, k + 1
        got = {r.node: r.wave for r in C.waves(spark.createDataFrame(edges, "src int, dst int")).collect()}
        assert got == want


def test_cycles_inside_components(spark):
    rng = random.Random(3)
    edges = sorted(set(_random(rng, 9, 22)))
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    want = set()

    def walk(way):
        for b in after.get(way[-1], []):
            if b == way[0]:
                want.add(tuple(way))
            elif b > way[0] and b not in way and len(way) < 5:
                walk([*way, b])

    for a in after:
        walk([a])
    got = [tuple(r.cycle) for r in C.cycles(spark.createDataFrame(edges, "src int, dst int"), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3


def _dense(edges):
    nodes = sorted({x for e in edges for x in e})
    at = {n: k for k, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for x, y in edges:
        if x != y:
            a[at[x], at[y]] = a[at[y], at[x]] = 1
    values, vectors = np.linalg.eigh(np.diag(a.sum(1)) - a)
    return nodes, values, vectors


def test_halves_equal_dense_ones(spark):
    rng = random.Random(4)
    two = [(a, b) for base in (0, 20) for a in range(base, base + 20) for b in range(a + 1, base + 20) if rng.random() < 0.4] + [(3, 25), (7, 31)]
    path = [(k, k + 1) for k in range(100, 105)]
    rows = [(1, *e) for e in two + two[:5]] + [(2, *e) for e in path] + [(3, 200, 201), (3, 201, 201)]
    got = C.spectral_halves(spark.createDataFrame(rows, "component int, src int, dst int"), tolerance=1e-4).collect()
    for c, edges in ((1, two), (2, path), (3, [(200, 201)])):
        nodes, values, vectors = _dense(edges)
        own = {r.node: r for r in got if r.component == c}
        assert set(own) == set(nodes)
        assert all(abs(r.connectivity - values[1]) < 1e-6 and r.residual < 1e-3 for r in own.values())
        side = vectors[:, 1] >= 0
        assert [own[n].side for n in nodes if abs(vectors[nodes.index(n), 1]) > 1e-6] == [int(s != side[0]) for n, s in zip(nodes, side, strict=True) if abs(vectors[nodes.index(n), 1]) > 1e-6]


@pytest.mark.parametrize("hot", [200_000, 15])
def test_tasks_of_halves_hold_no_more_of_more_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    monkeypatch.setattr(skew, "HOT", hot)
    rng = random.Random(5)
    edges = [(a, b) for base in (0, 30) for a in range(base, base + 30) for b in range(a + 1, base + 30) if rng.random() < 0.6] + [(3, 35)]
    stored, joined = [], []

    def kept(df):
        df = session.kept(df)
        stored.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] if "src" in df.columns else 0)
        return df

    def spread_join(left, right, key, *args, **options):
        df = skew.spread_join(left, right, key, *args, **options)
        if key == "src":
            joined.append(df.rdd.getNumPartitions())
        return df

    monkeypatch.setattr(C, "kept", kept)
    monkeypatch.setattr(C, "spread_join", spread_join)
    got = {r.node: r for r in C.spectral_halves(spark.createDataFrame([(1, *e) for e in edges], "component int, src int, dst int"), tolerance=1e-4).collect()}
    nodes, values, vectors = _dense(edges)
    assert max(stored) < 60 < len(edges) / 4 and min(joined) >= len(edges) / 10
    assert all(abs(got[n].connectivity - values[1]) < 1e-6 and got[n].side == ((vectors[k, 1] >= 0) != (vectors[0, 1] >= 0)) for k, n in enumerate(nodes))


def test_joins_of_loops_are_not_broadcast(spark):
    """A broadcast for every step would fill the driver's memory."""
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "src long, label long")
    for hot in ([], [2]):
        joined = skew.spread_join(edges, labels, "src", hot)
        assert joined.count() == 3 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    nodes, deep = C._entered(edges)
    assert {tuple(r) for r in nodes.collect()} == {(1, True, True), (2, True, True), (3, True, False)}
    assert {tuple(r) for r in deep.collect()} == {(1, 2), (2, 1), (2, 3)}


def _shuffled(spark, work):
    """Records that the stages of some work write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (lambda seq: [seq.apply(k) for k in range(seq.size())])(store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None))}
    before = stages()
    work()
    return sum(n for key, n in stages().items() if key not in before)


def test_steps_of_components_send_new_labels_only(spark):
    """Edges are dealt out once a round, and a node whose label stays sends nothing, however many steps a long ring takes."""
    rng = random.Random(6)
    edges = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(6000)} | {(1000 + k * 7 % 30, 1000 + (k + 1) * 7 % 30) for k in range(30)})
    frame = spark.createDataFrame(edges, "src long, dst long").checkpoint()
    found = {}
    sent = _shuffled(spark, lambda: found.update((r.node, r.component) for r in C.strong_components(frame).collect()))
    assert found == {k: 0 for k in range(300)} | {1000 + k: 1000 for k in range(30)}
    assert sent < 18 * len(edges), sent / len(edges)


def test_waves_need_components_only_when_they_are_many(spark, monkeypatch):
    rng = random.Random(7)
    # Two rings, one with a tail, a path that goes on, a loop, a hub, and a random graph.
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (70, 71), (71, 70), (9, 9), (20, 2)] + [(30 + k, 31 + k) for k in range(6)] + [(30, 40 + k) for k in range(5)] + [(100 + a, 100 + b) for a, b in _random(rng, 40, 44)]
    waiting = {x: {a for a, b in edges if b == x} for e in edges for x in e}
    want, k = {}, 0
    while waiting:
        ready = [n for n, v in waiting.items() if not v & set(waiting)] or list(waiting)
        want.update((n, k) for n in ready)
        waiting, k = {n: v for n, v in waiting.items() if n not in ready}, k + 1
    asked, whole = [], C._coloured
    monkeypatch.setattr(C, "_coloured", lambda *a: asked.append(1) or whole(*a))
    frame = spark.createDataFrame([*edges, (None, 1)], "src long, dst long")
    for most, hot in ((C.PEELED, 200_000), (3, 3)):
        monkeypatch.setattr(C, "PEELED", most)
        monkeypatch.setattr(skew, "HOT", hot)
        rows = C.waves(frame).collect()
        assert {r.node: r.wave for r in rows} == want and len(rows) == len(want) and len(asked) == (most == 3)
    assert C.waves(frame.where("src > 1000")).count() == 0
    assert [tuple(r) for r in C.waves(frame.where("src = 9")).collect()] == [(9, 0)]
