"""Plans and results that larger tables need."""

import pytest

from factloom.operators import parsing as P
from factloom.operators import stats


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    """As with large tables: nothing is broadcast for its size."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_call_bridges_sends_no_texts_to_the_driver(spark, monkeypatch):
    calls = spark.createDataFrame([(1, "solve(ab)"), (2, "a"), (3, "")], "call int, text string").coalesce(1).checkpoint()
    names = spark.createDataFrame([("solve",), ("a",), ("ve(",), ("zz",), ("",), ("a",)], "name string").coalesce(1)
    want = {(1, "solve"), (1, "ve("), (1, "a"), (2, "a")}
    for most in (P.NAMES, 2):
        monkeypatch.setattr(P, "NAMES", most)
        found = P.call_bridges(calls, names)
        plan = _plan(found)
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 2)
        rows = [tuple(r) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_anomalies_need_no_shuffle_by_metric(spark, no_small_tables):
    values = spark.createDataFrame([("a", float(k)) for k in range(20)] + [("a", 500.0), ("b", 1.0)], "metric string, value double")
    found = stats.zscore_anomalies(values, stats.baseline(values), 2.5)
    assert "SortMergeJoin" not in _plan(found)
    assert [(r.metric, r.value) for r in found.collect()] == [("a", 500.0)]


def test_small_matrices_come_many_at_a_time(spark, monkeypatch):
    """A call of Python for many groups, with groups that go on in the next batch, and null as a group."""
    import numpy as np

    from factloom.operators import graph as G

    calls = spark.sparkContext.accumulator(0)
    whole = G._in_groups

    def counted(rows, key, work, ddl):
        def once(pdf):
            calls.add(1)
            return work(pdf)

        return whole(rows, key, once, ddl)

    monkeypatch.setattr(G, "_in_groups", counted)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(1)
        shapes = {f"g{k}": [(int(a), int(b)) for a, b in rng.integers(0, 2 + k % 5, (1 + k % 11, 2))] for k in range(40)}
        shapes[None] = [(1, 2), (2, 3), (1, 3)]
        rows = spark.createDataFrame([(g, *e) for g, es in shapes.items() for e in es], "component string, src int, dst int")
        got = {}
        for r in G.fiedler_split(rows).collect():
            got.setdefault(r.component, {})[r.node] = (r.side, r.connectivity)
        assert set(got) == set(shapes) and calls.value < len(shapes)
        for g, es in shapes.items():
            nodes = sorted({x for e in es for x in e})
            a = np.zeros((len(nodes),) * 2)
            for s, d in es:
                if s != d:
                    a[nodes.index(s), nodes.index(d)] = a[nodes.index(d), nodes.index(s)] = 1
            values = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
            assert sorted(got[g]) == nodes and got[g][nodes[0]][0] == 0
            assert all(abs(c - (values[1] if len(nodes) > 1 else 0)) < 1e-9 for _, c in got[g].values())
        cells = [(k, m, int(i), int(j), float(w)) for k in range(30) for m in ("U", "M", "G")[: 1 + k % 3] for i, j, w in zip(*rng.integers(0, 3, (2, 4)), rng.random(4) / 9, strict=True)]
        frame = spark.createDataFrame(cells, "g long, matrix string, i int, j int, w double")
        found = {name: {(r.g, r.i, r.j): r.w for r in df.collect()} for name, df in (("wave", G.execution_wave(frame, 3)), ("slope", G.wave_gradient(frame, 3)), ("clamp", G.spectral_clamp(frame, 3, 0.1)))}
        for k in range(30):
            x = {m: np.zeros((3, 3)) for m in "UMG"}
            for g, m, i, j, w in cells:
                if g == k:
                    x[m][i, j] += w
            if k % 3 == 0:
                x["M"] = np.eye(3)
            inverse = np.linalg.inv(np.eye(3) - x["U"] @ x["M"])
            wants = {"wave": inverse @ x["U"], "slope": inverse.T @ x["G"] @ (np.eye(3) + x["M"].T @ (inverse @ x["U"]).T), "clamp": x["U"] * np.minimum(np.abs(np.linalg.eigvals(x["U"])), 0.9).mean()}
            for name, want in wants.items():
                assert all(abs(want[i, j] - found[name].get((k, i, j), 0.0)) < 1e-9 for i in range(3) for j in range(3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_index_blocks_stay_bounded(spark, monkeypatch):
    """Blocks grow in number with the rows, and a row visits the few nearby; each block has as many visits as its guests need."""
    import numpy as np
    from pyspark.sql import functions as F

    from factloom.operators import metric_index as M

    monkeypatch.setattr(M, "BLOCK", 20)
    monkeypatch.setattr(M, "VISIT", 30)
    x = np.random.default_rng(5).random((1500, 2))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    index = M.MetricIndex(rows, 3)
    visits = index._visits(index._own())
    groups = visits.groupBy("cell", "block", "visit").count()
    blocks = sum(index._blocks.values())
    assert 1500 / 20 <= blocks <= 400 and visits.count() < 10 * 1500 and groups.count() < 10 * blocks
    got = {}
    for r in index.neighbours().orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    for k in range(0, 1500, 7):
        assert got[k] == np.argsort(((x - x[k]) ** 2).sum(1), kind="stable")[:3].tolist()
    assert index.pruned().select(F.col("share") > 0.95).first()[0]


def test_nearest_coordinate_is_no_product_of_all_parts(spark, sf_dir):
    import __spark_entry__ as E

    assert "NestedLoop" not in _plan(E.queries()["nearest_coordinate"](spark, sf_dir))


def test_similar_pairs_that_round_to_the_cutoff(spark):
    from factloom.operators import similarity as S

    u = 0.7999996
    rows = [(1, 1, 1.0), (2, 1, u), (2, 2, (1 - u * u) ** 0.5)]
    got = S.similar_pairs(spark.createDataFrame(rows, "id long, feature long, value double"), 0.8)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 0.8)]


def test_close_pairs_of_dense_cells_are_many_tasks(spark, monkeypatch):
    import numpy as np

    from factloom.operators import similarity as S

    monkeypatch.setattr(S, "PAIRED", 5)
    monkeypatch.setattr(S, "TASK_PAIRS", 100)
    x = np.random.default_rng(6).random((60, 2)) * 4 - 2
    rows = spark.createDataFrame([(k, *v.tolist()) for k, v in enumerate(x)], "id long, x double, y double")
    got = S.close_pairs(rows, ["x", "y"], 1.5)
    assert got.rdd.getNumPartitions() >= 8
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if ((x[a] - x[b]) ** 2).sum() ** 0.5 < 1.5}
    rows = [(r.a, r.b) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_repaired_levels_read_their_edges_once(spark):
    from factloom.operators import graph as G

    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    edges = [(k, k + 1) for k in range(6)]
    frame = spark.createDataFrame(edges + [(9, 0)], "src long, dst long").mapInPandas(counted, "src long, dst long")
    before = G.levels(spark.createDataFrame(edges, "src long, dst long"))
    added, none = spark.createDataFrame([(9, 0)], "src long, dst long"), spark.createDataFrame([], "src long, dst long")
    got = {r.node: r.level for r in G.repaired_levels(before, frame, added, none).collect()}
    assert got == {9: 0} | {k: k + 1 for k in range(7)} and reads.value == 7
