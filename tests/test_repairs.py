"""Repaired levels, merged lines and seeded clusters against plain code."""

import itertools
import random

import numpy as np
import pytest

from factloom.operators import code, delta, graph, kmeans, ledger, similarity, stats


def test_repaired_levels(spark):
    rng = random.Random(6)
    before = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b}
    removed = set(rng.sample(sorted(before), 6))
    added = {(1, 39), (2, 41), (41, 42), (30, 31)} - before
    after = (before - removed) | added
    frame = lambda e: spark.createDataFrame(sorted(e), "src int, dst int")
    got = graph.repaired_levels(graph.levels(frame(before)), frame(after), frame(added), frame(removed)).collect()
    want = {r.node: r.level for r in graph.levels(frame(after)).collect()}
    assert {r.node: r.level for r in got} == want
    down = {b for _, b in added | removed}
    for _ in range(50):
        down |= {b for a, b in after if a in down}
    touched = {r.node for r in got if r.touched}
    assert touched <= down and len(touched) < len(want)
    with pytest.raises(graph.CycleError):
        graph.repaired_levels(graph.levels(frame({(1, 2), (2, 3)})), frame({(1, 2), (2, 3), (3, 1)}), frame({(3, 1)}), frame({(1, 2)}).limit(0))


def _longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines():
    rng = random.Random(7)
    for _ in range(2000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        found = delta.common_lines(a, b)
        assert len(found) == _longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x < u and y < v for (x, y), (u, v) in itertools.pairwise(found))


def test_merged_lines(spark):
    base = list("abcdefgh")
    assert delta.merged_lines(base, list("aXcdefgh"), list("abcdefYh")) == (list("aXcdefYh"), 0)
    assert delta.merged_lines(base, list("aXcdefgh"), list("aYcdefgh")) == (list("aYcdefgh"), 1)
    assert delta.merged_lines(base, list("acdefgh"), list("abcdefghi")) == (list("acdefghi"), 0)
    assert delta.merged_lines(base, list("aXcdefgh"), list("aXcdefgh")) == (list("aXcdefgh"), 0)
    rng = random.Random(8)
    for _ in range(500):
        one = [rng.choice("abc") for _ in range(rng.randint(0, 8))]
        other = [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        assert delta.merged_lines(one, other, one) == (other, 0) == delta.merged_lines(one, one, other) == delta.merged_lines(one, other, other)
    rows = lambda *x: spark.createDataFrame(list(x), "name string, body string")
    got = delta.three_way_merge(rows(("f", "a\nb\nc"), ("g", "x"), ("n", None)), rows(("f", "A\nb\nc"), ("g", "y"), ("n", "l")), rows(("f", "a\nb\nC"), ("g", "z"), ("n", "r")), ["name"], "body", lines=True)
    assert sorted(map(tuple, got.collect())) == [("f", "A\nb\nC", "merged"), ("g", "z", "conflict"), ("n", "r", "conflict")]


def test_clusters(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.05 + 3 * c for c in np.eye(3)])
    rows = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, vector array<double>")
    runs = [sorted((r.id, r.cluster) for r in kmeans.clusters(rows.repartition(n), 3).collect()) for n in (2, 5)]
    assert runs[0] == runs[1]
    label = [c for _, c in runs[0]]
    assert len({tuple(sorted(set(label[k : k + 60]))) for k in (0, 60, 120)}) == 3 and len(set(label)) == 3
    centres = x[[0, 1, 70]]
    want = centres
    for _ in range(3):
        own = ((x[:, None] - want) ** 2).sum(2).argmin(1)
        want = np.array([x[own == c].mean(0) if (own == c).any() else want[c] for c in range(3)])
    assert np.allclose(kmeans.lloyd(rows, centres, 3), want)
    assert kmeans.clusters(rows.where("id < 0"), 3).count() == 0
    assert {r.cluster for r in kmeans.clusters(rows.limit(2), 5).collect()} == {0, 1}


def test_long_chain_and_series(spark):
    import hashlib

    rows = spark.createDataFrame([(c, k, None if k == 700 else f"p{k % 7}") for c in ("a", None) for k in range(1500)], "c string, k int, p string")
    got = ledger.chained(rows.repartition(4), "c", "k", "p").collect()
    last, want = "", []
    for k in range(1500):
        made = None if k == 700 else hashlib.sha256(f"{last}|{k}|p{k % 7}".encode()).hexdigest()
        want.append((k, last, made))
        last = made or ""
    for c in ("a", None):
        assert sorted((r.t_causal, r.prev_hash, r.block_hash) for r in got if r.c == c) == sorted(want)
    ema = 0.0
    for k in range(1500):
        ema = 0.1 * (k % 5) + 0.9 * ema
    series = rows.selectExpr("coalesce(c, 'b') AS c", "k", "cast(k % 5 AS double) AS v")
    out = {r.c: (r.n, r.ema) for r in stats.moving_average(series, "c", "k", "v").collect()}
    assert out["a"][0] == 1500 and abs(out["a"][1] - ema) < 1e-9


def test_hot_feature_and_dense_cell_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRED", 10)
    rng = random.Random(3)
    rows = [(i, f, 1.0) for i in range(60) for f in {0, *(rng.randrange(5) for _ in range(3))}]
    own = {}
    for i, f, _ in rows:
        own.setdefault(i, set()).add(f)
    want = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) / (len(own[a]) * len(own[b])) ** 0.5 >= 0.8 - 1e-9}
    got = similarity.similar_pairs(spark.createDataFrame(rows, "id int, feature int, value double"), 0.8).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    points = [(k, rng.random(), rng.random()) for k in range(60)] + [(100, 9.0, 9.0)]
    near = similarity.close_pairs(spark.createDataFrame(points, "id int, x double, y double"), ["x", "y"], 0.5).collect()
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 < 0.5}
    assert len(near) == len(want) and {(r.a, r.b) for r in near} == want


def test_evolution(spark, tmp_path):
    from pyspark.sql import functions as F

    from factloom.plans import pipelines

    rng = random.Random(5)
    rows = spark.createDataFrame([(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(60)], "uid long, a double, b double")
    aims = {"p": F.pow(F.col("a") - 2, 2) + F.col("b"), "q": F.pow(F.col("a") - 6, 2) + F.col("b")}
    genes = {"a": (0.0, 10.0), "b": (0.0, 10.0)}
    runs = [pipelines.evolved(rows.repartition(n), genes, aims, 40, 2, seed=3, path=str(tmp_path / f"run{n}")) for n in (1, 4)]
    found = [sorted(map(tuple, now.select("uid", "a", "b", "front").collect())) for now, _ in runs]
    assert found[0] == found[1] and len(found[0]) == 40
    assert all(0 <= r[1] <= 10 and 0 <= r[2] <= 10 for r in found[0])
    told = runs[0][1].orderBy("generation").collect()
    first = rows.select(F.min(aims["p"]), F.min(aims["q"])).first()
    # The best of each objective never goes.
    assert told[0].best_p <= first[0] and told[1].best_p <= told[0].best_p and told[1].best_q <= told[0].best_q <= first[1]
    assert spark.read.parquet(str(tmp_path / "run1")).groupBy("generation").count().count() == 2
    assert pipelines.evolved(rows, genes, aims, 40, 0)[1].count() == 0


def test_imports_from_utilities_first(spark):
    files = [("a.py", "def f(): pass\ndef g(): pass\n"), ("b.py", "def g(): pass\nf()\nh()\n"), ("c.py", "f()\ng()\nprint(nowhere)\n"), ("utils.py", "def f(): pass\n")]
    roles = code.name_roles(spark.createDataFrame(files, "path string, text string"))
    assert sorted(map(tuple, code.missing_imports(roles).collect())) == [("b.py", "f", "a.py"), ("c.py", "f", "a.py"), ("c.py", "g", "a.py")]
    own = spark.createDataFrame([("f", "utils.py"), ("h", "utils.py")], "name string, provider string")
    assert sorted(map(tuple, code.missing_imports(roles, own).collect())) == [("b.py", "f", "utils.py"), ("b.py", "h", "utils.py"), ("c.py", "f", "utils.py"), ("c.py", "g", "a.py")]
