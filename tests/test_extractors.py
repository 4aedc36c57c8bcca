"""Table functions, the polling stream, and the projector."""

import os
import time

import numpy as np

from factloom.operators import extractors, graph
from factloom.streaming import workspace


def test_extractors_as_table_functions(spark):
    docs = spark.createDataFrame([(1, "Let x be the rate. x must remain between 1 and 2."), (2, None), (3, "a = b + 2 (c)")], "doc int, text string")
    got = [tuple(r) for r in extractors.extracted(docs, extractors.rules, extractors.RULES).collect()]
    assert (1, "boundary", "x", "1 <= x <= 2") in got and not any(r[0] == 2 for r in got)
    extractors.registered(spark, "own_tokens", extractors.tokens, extractors.TOKENS)
    docs.createOrReplaceTempView("own_docs")
    rows = spark.sql("SELECT d.doc, t.token, t.depth FROM own_docs d, LATERAL own_tokens(d.text) t WHERE d.doc = 3 ORDER BY t.n").collect()
    assert [r.token for r in rows] == ["a", "=", "b", "+", "2", "(", "c", ")"] and [r.depth for r in rows][6] == 1


def test_projector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    rows = [(k, list(map(float, v)) if k % 4 else None, 1.0 if k % 9 == 0 else 0.1, f"r{k}") for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "k int, v array<double>, gain double, text string")
    got = np.zeros((5, 5))
    for r in graph.projector(frame, "k", "v", "gain", "text", 5).collect():
        got[r.i, r.j] = r.value
    own = np.array([x[k] if k % 4 else graph.hashed_vector(f"r{k}", 5) for k in range(8, 40) if k % 9 == 0])
    assert np.allclose(got, np.linalg.pinv(own) @ own)
    few = graph.projector(frame.limit(2), "k", "v", "gain", "text", 5).collect()
    assert {(r.i, r.j) for r in few if r.value} == {(k, k) for k in range(5)}


def test_polled_workspace_goes_on_after_a_restart(spark, tmp_path):
    folder, out = tmp_path / "work", f"file://{tmp_path}/out"
    os.makedirs(folder)
    (folder / "a.txt").write_text("1")
    (folder / "b.txt").write_text("1")

    def run(until):
        q = workspace.polled(spark, f"file://{folder}", out, f"file://{tmp_path}/check", every="1 second")
        end = time.time() + 60
        try:
            while time.time() < end:
                time.sleep(1)
                done = {(os.path.basename(r.path), r.status) for r in workspace.changes(spark, out).collect()} if os.path.exists(f"{tmp_path}/out/changes/batch=0/_SUCCESS") else set()
                if until <= done:
                    return done
        finally:
            q.stop()
        raise AssertionError(q.exception() or "no change seen")

    assert run({("a.txt", "created"), ("b.txt", "created")}) == {("a.txt", "created"), ("b.txt", "created")}
    (folder / "a.txt").write_text("2")
    (folder / "b.txt").unlink()
    (folder / "c.txt").write_text("3")
    done = run({("a.txt", "changed"), ("b.txt", "removed"), ("c.txt", "created")})
    assert len(done) == 5 and workspace.changes(spark, out).count() == 5
