"""Work of pairs and of the index that must not grow faster than its result needs."""

import numpy as np


def _shuffled(spark) -> int:
    """Rows that all stages so far wrote for others."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_below_the_cutoff_are_not_shuffled(spark):
    from factloom.operators import similarity as S

    # Each two with the same first feature have another second one, which is the longer.
    rows = [(k, f, v) for k in range(3000) for f, v in ((k % 100, 3.0), (1000 + k // 100, 5.0))] + [(5000, 0, 3.0), (5000, 1000, 5.0)]
    frame = spark.createDataFrame(rows, "id long, feature long, value double").repartition(4, "id")
    before = _shuffled(spark)
    got = S.similar_pairs(frame, 0.8).collect()
    assert [tuple(r) for r in got] == [(0, 5000, 1.0)]
    assert _shuffled(spark) - before < 60_000  # 43,500 pairs share a feature


def test_similar_pairs_whatever_is_ranked(spark, monkeypatch):
    from factloom.operators import similarity as S

    rng = np.random.default_rng(11)
    rows = {(int(i), int(f)): float(rng.integers(-2, 9)) for i, f in zip(rng.integers(0, 80, 700), rng.zipf(1.4, 700) % 60, strict=True)}
    frame = spark.createDataFrame([(i, f, v) for (i, f), v in rows.items()] + [(None, 1, 1.0), (90, None, 2.0), (90, 1, None)], "id int, feature int, value double")
    m = np.zeros((80, 60))
    for (i, f), v in rows.items():
        m[i, f] = v
    n = np.sqrt((m * m).sum(1))
    want = {(a, b): round(m[a] @ m[b] / n[a] / n[b], 6) for a in range(80) for b in range(a + 1, 80) if n[a] and n[b] and m[a] @ m[b] / n[a] / n[b] >= 0.7}
    for ranked, paired in ((0, 2_000), (5, 2_000), (5, 3), (200_000, 2_000)):
        monkeypatch.setattr(S, "RANKED", ranked)
        monkeypatch.setattr(S, "PAIRED", paired)
        got = S.similar_pairs(frame, 0.7).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want


def test_products_decide_exactly(monkeypatch):
    from factloom.operators import metric_index as M
    from factloom.operators.similarity import _exact

    rng = np.random.default_rng(3)
    monkeypatch.setattr(M, "TILE", 16)
    monkeypatch.setattr(M, "WIDE", 40)
    wide = np.concatenate([rng.normal(size=(150, 9)), rng.normal(size=(150, 9)) * 1e-4 + 50])
    for y in (wide, rng.integers(0, 2, (400, 9)).astype(float), np.zeros((7, 9)), wide * 1e30, np.repeat(np.eye(9), 200, 0)):
        x, ids = y[:: max(1, len(y) // 70)], rng.permutation(len(y))
        for metric in ("euclidean", "cosine"):
            for k in (1, 5):
                q, p, far = M._measured(metric, x, ids, y, k)
                for j in range(len(x)):
                    d = _exact(metric, y, np.repeat(x[j][None], len(y), 0))
                    assert sorted(zip(far[q == j], ids[p[q == j]])) == sorted(zip(d, ids))[:k]


def test_products_serve_both_sides(monkeypatch):
    from factloom.operators import metric_index as M
    from factloom.operators.similarity import _exact

    rng = np.random.default_rng(5)
    monkeypatch.setattr(M, "TILE", 16)
    monkeypatch.setattr(M, "WIDE", 40)
    for y in (rng.normal(size=(301, 9)), rng.integers(0, 2, (400, 9)).astype(float), np.zeros((7, 9))):
        x, ids, own = np.concatenate([rng.normal(size=(60, 9)), rng.integers(0, 2, (9, 9)), np.zeros((1, 9))]), rng.permutation(len(y)), rng.permutation(70)
        for metric in ("euclidean", "cosine"):
            *there, q, p, far = M._measured(metric, x, ids, y, 4, own=own)
            for (q, p, far), at, of, names in ((there, x, y, ids), ((q, p, far), y, x, own)):
                for j in range(len(at)):
                    d = _exact(metric, of, np.repeat(at[j][None], len(of), 0))
                    assert sorted(zip(far[q == j], names[p[q == j]])) == sorted(zip(d, names))[:4]


def test_vectors_at_right_angles_go_by_parts(spark, monkeypatch):
    from factloom.operators import metric_index as M
    from factloom.operators.similarity import _exact

    monkeypatch.setattr(M, "BLOCK", 25)
    monkeypatch.setattr(M, "PART", 150)
    x = np.random.default_rng(4).normal(size=(600, 48))
    x[100:103], x[300] = x[7], 0.0
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    before = _shuffled(spark)
    for metric in ("euclidean", "cosine"):
        index = M.MetricIndex(rows, 4, metric)
        got = {}
        for r in index.neighbours().orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.distance, r.neighbour))
        for k in range(600):
            d = _exact(metric, x, np.repeat(x[k][None], 600, 0))
            assert got[k] == sorted(zip(d.tolist(), range(600)))[:4]
        assert index.pruned().first().share == 0
    # Rows went to 4 parts each, not to every one of about 36 blocks.
    assert _shuffled(spark) - before < 60_000
