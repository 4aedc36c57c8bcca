"""Edge cases and properties of operators."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import states as S
from factloom.functions import text as T
from factloom.operators import delta, facts, graph, ledger, pareto, similarity, stats
from factloom.sources import config

FEW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_entropy_of_known_texts(spark):
    rows = [("a b c d e f g h", 3.0), ("x x x x", 0.0), ("hello", 0.0), ("", 0.0), ("a a b b c c", math.log2(3)), (None, 0.0)]
    df = spark.createDataFrame(rows, "text string, want double").select("want", T.entropy(T.tokens(F.col("text"))).alias("got"))
    assert all(abs(r.want - r.got) < 1e-9 for r in df.collect())


@FEW
@given(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=30))
def test_entropy_is_bounded(spark, words):
    h = spark.createDataFrame([(" ".join(words),)], "t string").select(T.entropy(T.tokens(F.col("t")))).first()[0]
    assert -1e-9 <= h <= math.log2(len(words)) + 1e-9


def test_disambiguation_by_arrival(spark):
    rows = [(1, "d", "x"), (2, "d", "x"), (3, "d", "x"), (4, "other", "x")]
    df = spark.createDataFrame(rows, "seq int, domain string, symbol string").withColumn("kind", F.lit("variable"))
    assert [r.unique_symbol for r in facts.disambiguated(df).orderBy("seq").collect()] == ["x", "x#2", "x#3", "x"]


def test_pareto_example(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 3.0)], "id string, x double, y double")
    assert [r.id for r in pareto.frontier(df, ["x", "y"]).collect()] == ["a"]
    four = spark.createDataFrame([("a", 1.0, 5.0), ("b", 5.0, 1.0), ("c", 3.0, 3.0), ("d", 10.0, 10.0)], "id string, x double, y double")
    ranked = pareto.crowding(pareto.fronts(four, ["x", "y"]), ["x", "y"], "front", "id")
    assert {r.id for r in pareto.select_best(ranked, 2, "id").collect()} == {"a", "b"}
    none = four.where("x > 100")
    assert pareto.frontier(none, ["x", "y"]).count() == 0
    assert pareto.fronts(none, ["x", "y"]).count() == 0


@FEW
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_frontier_against_brute_force(spark, points):
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id int, x double, y double")
    got = {r.id for r in pareto.frontier(df.repartition(3), ["x", "y"]).collect()}
    want = {k for k, p in enumerate(points) if not any(q[0] <= p[0] and q[1] <= p[1] and q != p for q in points)}
    assert got == want


def test_fronts_against_peeling(spark):
    rng = np.random.default_rng(4)
    for n, minimize, block in ((2, True, 100_000), (2, False, 20), (3, True, 3)):
        names = ["x", "y", "z"][:n]
        values = [[None if v == 6 else float(v) for v in row] for row in rng.integers(0, 7, (60, n))]
        df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id long, " + ", ".join(f"{c} double" for c in names))
        p = np.array([[(np.inf if minimize else 0.0) if v is None else v for v in row] for row in values]) * (1 if minimize else -1)
        want, left, k = {}, set(range(len(p))), 0
        while left:
            front = {i for i in left if not any((p[j] <= p[i]).all() and (p[j] < p[i]).any() for j in left)}
            want |= dict.fromkeys(front, k)
            left, k = left - front, k + 1
        got = {r.id: r.front for r in pareto.fronts(df.repartition(3), names, minimize, block=block).collect()}
        assert got == want


def test_whole_pareto_queries_against_brute_force(spark, sf_dir):
    from factloom.plans.catalog import QUERIES

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice", "p_size").toPandas()
    key, p = part["p_partkey"].to_numpy(), np.stack([part["p_retailprice"], -part["p_size"].astype("f8")], 1)
    front, left = np.full(len(p), -1), np.ones(len(p), bool)
    while left.any():
        rest = np.flatnonzero(left)
        q = p[rest]
        worse = ((q[None] <= q[:, None]).all(2) & (q[None] < q[:, None]).any(2)).any(1)
        front[rest[~worse]] = front.max() + 1
        left[rest[~worse]] = False
    crowd = np.zeros(len(p))
    for f in range(front.max() + 1):
        own = np.flatnonzero(front == f)
        for x in p.T:
            order = own[np.lexsort([key[own], x[own]])]
            crowd[order[[0, -1]]] = np.inf
            span = x[own].max() - x[own].min()
            if span > 0:
                crowd[order[1:-1]] += (x[order[2:]] - x[order[:-2]]) / span
    best = sorted(range(len(p)), key=lambda i: (front[i], -crowd[i], key[i]))
    rows = lambda name: [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]
    assert dict(rows("pareto_fronts")) == dict(zip(key, front, strict=True))
    got = dict(rows("crowding_distance"))
    assert len(got) == len(p) and all(abs(got[k] - (-1 if np.isinf(c) else c)) < 2e-6 for k, c in zip(key, crowd, strict=True))
    assert rows("select_best") == [(key[i], front[i]) for i in best[:25]]
    assert rows("best_individual") == [(key[best[0]],)]


def test_fronts_of_a_long_chain(spark):
    df = spark.range(1_200).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert {(r.id, r.front) for r in pareto.fronts(df, ["x", "y"]).collect()} == {(k, k) for k in range(1_200)}


def test_levels_and_cycles(spark):
    diamond = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {r.node: r.level for r in graph.levels(diamond).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    loop = diamond.unionByName(spark.createDataFrame([("d", "a")], "src string, dst string"))
    with pytest.raises(graph.CycleError):
        graph.levels(loop)
    assert graph.levels(diamond.where("src = 'z'")).count() == 0


def test_cache_invalidation(spark):
    cache = spark.createDataFrame([("base", "1"), ("child", "2"), ("other", "3")], "key string, fingerprint string")
    edges = spark.createDataFrame([("base", "child")], "src string, dst string")
    new = lambda f: spark.createDataFrame([("base", f)], "key string, fingerprint string")
    assert {r.key for r in graph.invalidated(cache, edges, new("9")).collect()} == {"other"}
    assert graph.invalidated(cache, edges, new("1")).count() == 3


def test_chain_verifies_and_shows_forgery(spark):
    rows = spark.createDataFrame([("c", k, f"p{k}") for k in range(4)], "chain string, seq int, payload string")
    chain = ledger.chained(rows, "chain", "seq", "payload")
    assert ledger.chain_faults(chain, "chain").count() == 0
    forged = chain.withColumn("payload", F.when(F.col("t_causal") == 0, "x").otherwise(F.col("payload")))
    assert [(r.t_causal, r.fault) for r in ledger.chain_faults(forged, "chain").collect()] == [(0, "content")]
    assert ledger.chain_faults(forged, "chain", content=False).count() == 0
    assert ledger.chain_faults(chain.where("t_causal <> 1"), "chain").count() >= 1


def test_upsert_keeps_latest(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, version int")
    new = spark.createDataFrame([(1, "c", 2), (2, "old", 4), (3, "n", 1)], "k int, v string, version int")
    assert sorted(map(tuple, ledger.upserted(table, new, ["k"], "version").collect())) == [(1, "c", 2), (2, "b", 5), (3, "n", 1)]


def test_baseline_of_one_value_and_no_spread(spark):
    one = spark.createDataFrame([("m", 4.0)], "metric string, value double")
    assert tuple(stats.baseline(one).first()) == ("m", 4.0, 1.0, 1)
    flat = spark.createDataFrame([("m", 4.0)] * 3, "metric string, value double")
    assert stats.zscore_anomalies(flat, stats.baseline(flat)).count() == 0


def test_kinetics_counts_a_plateau(spark):
    rows = spark.createDataFrame([("s", k, 1.0) for k in range(20)], "series string, seq int, score double")
    out = stats.kinetics(rows, "series", ["seq"], "score").orderBy("seq").collect()
    assert [r.stall for r in out] == [0, 0, *range(1, 19)]
    assert sum(r.stagnant for r in out) == 4


def test_knn_pads_and_breaks_ties(spark):
    v = lambda c: similarity.padded(F.col(c), 3)
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0, 0.0, 9.0]), (3, [5.0])], "id int, vector array<double>").withColumn("vector", v("vector"))
    probes = spark.createDataFrame([(7, [0.0])], "probe int, vector array<double>").withColumn("vector", v("vector"))
    assert [(r.id, r.distance) for r in similarity.nearest(rows, probes, 2).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]
    assert similarity.nearest(rows, probes, 1, "cosine").first().distance == 1.0


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (25, 6)).astype(float)
    rows = [(i, f, float(x[i, f])) for i in range(25) for f in range(6) if x[i, f]]
    got = {(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame(rows, "id int, feature int, value double"), 0.9).collect()}
    n = np.linalg.norm(x, axis=1)
    want = {(i, j) for i in range(25) for j in range(i + 1, 25) if n[i] and n[j] and round(x[i] @ x[j] / n[i] / n[j], 6) >= 0.9}
    assert got == want


def test_hypervolume_grows_with_points(spark):
    df = spark.createDataFrame([("g", 1.0, 3.0), ("g", 3.0, 1.0), ("g", 1.0, 1.0)], "g string, x double, y double")
    volume = lambda d: pareto.hypervolume_2d(d, "x", "y", (0.0, 0.0), "g").first().hypervolume
    assert volume(df) == 5.0
    assert volume(df.unionByName(spark.createDataFrame([("g", 2.0, 2.0)], df.schema))) == 6.0


def test_states(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,), (float("nan"),), (float("inf"),), (4.0,)], "s double")
    assert [r[0] for r in df.select(S.inverse_seconds(F.col("s"))).collect()] == [1e9, 0.0, 0.0, 0.0, 0.0, 0.25]


def test_snapshot_of_empty_sides(spark):
    a = spark.createDataFrame([(1, "x")], "k int, f string")
    assert [r.status for r in delta.snapshot_diff(a, a.where("k > 1"), "k", "f").collect()] == ["removed"]
    assert delta.snapshot_diff(a, a, "k", "f").count() == 0


def test_configurations():
    assert config.sniff('{"a": 1}') == "json"
    assert config.read('target core {\n  requires = [base]\n  size = 3\n}')[0] == {"kind": "target", "name": "core", "requires": ["base"], "size": 3}
    assert config.read("project: demo\nfast: yes\ningest:\n  - a.txt\n  - b.txt\n") == {"project": "demo", "fast": True, "ingest": ["a.txt", "b.txt"]}
    assert config.read("[build]\nn = 2\n") == {"build": {"n": 2}}
    assert config.validated([{"name": "a", "requires": ["b"]}]) == ["a requires unknown b"]
    assert config.validated([{"name": "a", "requires": ["b"]}, {"name": "b", "requires": ["a"]}])[0].startswith("cycle")
    assert config.validated([{"name": "a", "requires": []}]) == []
    assert graph.kahn_order([("top", ["l", "r"]), ("l", ["b"]), ("r", ["b"]), ("b", [])]) == ["b", "l", "r", "top"]


def test_champions_and_compromise(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": [1, 2, 3], "x": [1.0, 5.0, 4.0], "y": [5.0, 1.0, 4.0]}))
    assert pareto.compromise(df, ["x", "y"], "id").first().id == 3
    assert {(r.objective, r.member) for r in pareto.champions(df, ["x", "y"], "id").collect()} == {("x", 2), ("y", 1)}
