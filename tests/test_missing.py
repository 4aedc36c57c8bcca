"""Operators that statements can't check: syntax against a plain walk, streams, folders and errors."""

import ast
import json

import numpy as np
import pytest

from factloom.operators import code, facts, graph, pareto, parsing, routing, similarity
from factloom.sources import config, files
from factloom.streaming import routes


def test_syntax_statistics_against_a_walk(spark, sf_dir):
    from factloom.plans.catalog import QUERIES
    from factloom.plans.code_queries import FILES

    def depth(node):
        return 1 + max((depth(c) for c in ast.iter_child_nodes(node)), default=-1)

    want = {}
    for path, text in FILES.rows:
        try:
            tree = ast.parse(text)
        except SyntaxError:
            continue
        # The files stand once for each supplier, under its number.
        for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").collect():
            want[path.replace("@", str(r.s_suppkey))] = (sum(1 + 0 * len(n._fields) for n in _tree(tree)), depth(tree))
    assert {r.path: (r.nodes, r.depth) for r in QUERIES["syntax_statistics"](spark, sf_dir).collect()} == want


def _tree(node):
    yield node
    for c in ast.iter_child_nodes(node):
        yield from _tree(c)


def test_function_rules(spark):
    rows = [("a.py", "def fib(n):\n    return fib(n-1)+fib(n-2)\n")]
    assert [r.score for r in code.function_scores(spark.createDataFrame(rows, "path string, text string")).collect()] == [5.5]
    symbols = code.python_symbols(spark.createDataFrame([("a", "class B:\n  def f(self): pass\ndef f(): pass\nasync def g(): pass\n"), ("b", "def (")], "path string, text string"))
    assert [tuple(r) for r in symbols.collect()] == [("a", ["f", "g"], ["B"])]
    assert code.python_facts(spark.createDataFrame([], "path string, text string")).count() == 0


def test_pattern_scores_of_nothing(spark):
    rows = spark.createDataFrame([("a.js", ""), ("b.rs", None), ("c.py", "def f(): pass")], "path string, text string")
    assert routing.pattern_scores(rows).count() == 0
    got = routing.routes(routing.routing_reasons(rows)).collect()
    assert [(r.path, r.function, r.cold) for r in got] == [("c.py", "f", False)]


@pytest.mark.parametrize("minimize", [True, False])
def test_frontier_against_brute_force(spark, monkeypatch, minimize):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 40, (1500, 3)).astype(float), np.stack([np.arange(300.0), 300 - np.arange(300.0), np.zeros(300)], 1)])
    rows = [(k, *map(float, p)) for k, p in enumerate(x)] + [(9000, None, 1.0, 1.0), (9001, 5.0, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(7)
    whole = np.array([[np.inf if v is None and minimize else 0.0 if v is None else v for v in r[1:]] for r in rows]) * (1 if minimize else -1)
    want = {r[0] for r, p in zip(rows, whole, strict=True) if not ((whole <= p).all(1) & (whole < p).any(1)).any()}
    for last in (50_000, 100):  # in one task, and by a join
        monkeypatch.setattr(pareto, "LAST", last)
        assert {r.id for r in pareto.frontier(df, ["a", "b", "c"], minimize).collect()} == want
    assert pareto.frontier(df.limit(0), ["a", "b", "c"], minimize).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_ranks_by_exact_distances(spark, metric):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    x[:40] = x[0] + rng.normal(size=(40, 8)) * 1e-7
    x[40:50] = x[1]
    x[50] = 0
    rows = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    got = similarity.nearest(rows, rows.where("id % 7 = 0").withColumnRenamed("id", "probe"), 6, metric).collect()
    for p in range(0, 300, 7):
        if metric == "euclidean":
            d = [np.sqrt(sum((a - b) ** 2 for a, b in zip(x[k], x[p], strict=True))) for k in range(300)]
        else:
            dot = lambda a, b: sum(u * v for u, v in zip(a, b, strict=True))
            d = [1 - dot(x[k], x[p]) / (np.sqrt(dot(x[k], x[k])) * np.sqrt(dot(x[p], x[p]))) if np.any(x[k]) and np.any(x[p]) else 1.0 for k in range(300)]
        assert [r.id for r in sorted((r for r in got if r.probe == p), key=lambda r: r["rank"])] == sorted(range(300), key=lambda k: (d[k], k))[:6]
    assert similarity.nearest(rows, rows.limit(0).withColumnRenamed("id", "probe"), 3, metric).count() == 0


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = {(int(i), int(f)): float(rng.integers(-3, 9)) for i, f in zip(rng.integers(0, 60, 500), rng.zipf(1.5, 500) % 40, strict=True)}
    m = np.zeros((60, 40))
    for (i, f), v in rows.items():
        m[i, f] = v
    n = np.sqrt((m * m).sum(1))
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if n[a] and n[b] and m[a] @ m[b] / n[a] / n[b] >= 0.6}
    got = similarity.similar_pairs(spark.createDataFrame([(i, f, v) for (i, f), v in rows.items()], "id int, feature int, value double"), 0.6)
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 3


def test_cycle_of_acyclic_and_self(spark):
    e = lambda *x: spark.createDataFrame(list(x), "src string, dst string")
    assert graph.one_cycle(e(("a", "b"), ("b", "c"))).count() == 0
    assert [tuple(r) for r in graph.one_cycle(e(("a", "a"), ("a", "b"))).collect()] == [("a", 0)]
    ring = [(f"n{k:03d}", f"n{(k + 1) % 37:03d}") for k in range(37)]
    assert {r.node: r.place for r in graph.one_cycle(e(*ring, ("x", "n005"))).collect()} == {f"n{k:03d}": k for k in range(37)}


def test_links_to_nothing_are_an_error(spark):
    known = spark.createDataFrame([("a::x",)], "fact_id string")
    links = spark.createDataFrame([("a", "x", "b", "y", None)], "domain_a string, symbol_a string, domain_b string, symbol_b string, relation string")
    with pytest.raises(Exception, match="no fact b::y"):
        facts.linked_domains(known, links).collect()


def test_route_stream_keeps_its_state(spark, tmp_path):
    schema = "key string, seq long, at double, strategy string, score double, minimum double"
    rows = [("k", n, 1000.0 + n, "direct", 0.1, 0.5) for n in range(4)] + [("k", 9, 1400.0, "direct", 0.1, 0.5)]
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n, part in enumerate((rows[:1], rows[1:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
        stream = routes.routed_stream(spark.readStream.schema(schema).json(str(source)), ["cached", "reduced"], "restart")
        running = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert running.awaitTermination(90)
    want = [(0, "cached", 1), (1, "reduced", 2), (2, "restart", 2), (3, "restart", 2), (9, "cached", 1)]
    assert sorted((r.seq, r.strategy, r.depth) for r in spark.read.parquet(str(out)).collect()) == want


def test_workspace_bytes_and_ini(spark, tmp_path):
    (tmp_path / "__pycache__").mkdir()
    for name, text in (("a.py", "12345"), ("b.txt", "no"), ("__pycache__/c.py", "1"), ("d.py", "12")):
        (tmp_path / name).write_text(text)
    assert files.workspace_bytes(files.listing(spark, str(tmp_path))).first().bytes == 7
    assert files.workspace_bytes(files.listing(spark, str(tmp_path / "none"))).first().bytes == 0
    text = "top = 1\n[build]\nname = core lib\nfast = yes\n; note\n[x]\nlist: [1, 2]\n"
    assert config.sniff(text) == "ini" and config.read(text) == {"": {"top": 1}, "build": {"name": "core lib", "fast": True}, "x": {"list": [1, 2]}}
    assert config.sniff('[a]\nb = "c"\n') == "toml" and config.read('[a]\nb = "c"\n') == {"a": {"b": "c"}}


def test_diagnostics_of_empty_and_partial_json(spark):
    rows = [(1, ""), (2, None), (3, "{}"), (4, json.dumps({"message": "m", "spans": None})), (5, "[]"), (6, "[1, 2]")]
    assert parsing.compiler_messages(spark.createDataFrame(rows, "id int, out string")).count() == 0
    warned = spark.createDataFrame([(1, json.dumps({"message": "m", "level": "warning", "spans": [{"file_name": "a"}]}))], "id int, out string")
    assert [(r.level, r.file, r.line) for r in parsing.compiler_messages(warned, errors_only=False).collect()] == [("warning", "a", 1)]


def test_ingest_of_a_folder(spark, tmp_path):
    from factloom.plans import pipelines

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("class A:\n    def run(self):\n        return 1\n")
    (tmp_path / "src" / "b.py").write_text("def (:\n")
    (tmp_path / "src" / "c.txt").write_text("no source")
    rows, errors = pipelines.ingest(spark, str(tmp_path / "src"), "ctx")
    got = {r.path.rpartition("/")[2]: r for r in rows.collect()}
    assert set(got) == {"a.py"} and got["a.py"].functions == ["run"] and got["a.py"].types == ["A"] and got["a.py"].language == "python" and len(got["a.py"].semantic_hash) == 64
    assert [r.path.rpartition("/")[2] for r in errors.collect()] == ["b.py"]
    (tmp_path / "src" / "a.py").write_text("class A:\n    def walk(self):\n        return 1\n")
    again, _ = pipelines.ingest(spark, str(tmp_path / "src"), "ctx", registry=rows)
    assert [(r.context, r.functions, r.version) for r in again.collect()] == [("ctx", ["walk"], 2)]
    assert pipelines.ingest(spark, str(tmp_path / "none"), "ctx")[0].count() == 0
