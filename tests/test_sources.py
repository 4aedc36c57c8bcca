import json
import zlib

from factloom.sources import files

BLOCK = "struct<t:bigint,payload:string>"


def test_documents_and_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.txt").write_bytes(b"caf\xe9 text")
    (tmp_path / "sub" / "b.json").write_text("{}")
    (tmp_path / "sub" / "c.xyz").write_text("no")
    (tmp_path / "node_modules" / "d.py").write_text("x = 1")
    (tmp_path / "e.pdf").write_bytes(b"%PDF\n<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"(Hello \\(you\\)) Tj [(a) 3 (b)] TJ") + b"\nendstream")
    got = {r.path.rpartition("/")[2]: (r.format, r.text, r.error) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "caf text", None), "b.json": ("json", "{}", None), "e.pdf": ("pdf", "Hello (you) a b \n", None)}
    assert files.documents(spark, str(tmp_path / "none")).count() == 0
    assert sorted(r.relative for r in files.listing(spark, str(tmp_path)).collect()) == ["a.txt", "e.pdf", "sub/b.json", "sub/c.xyz"]
    assert files.listing(spark, str(tmp_path), "*.json").count() == 1


def test_scanned_fields(spark, tmp_path):
    (tmp_path / "k").write_text("KEY=1\nnoise\nKEY=2\nB=x=y\n")
    row = files.scanned(spark, str(tmp_path)).first()
    assert row.fields == {"KEY": "2", "B": "x=y"} and len(row.fingerprint) == 16 and row.size == 24


def test_ledger_shapes(spark, tmp_path):
    rows = [{"t": 0, "payload": "a"}, {"t": 1, "payload": "b"}]
    for name, text in (("lines", "\n".join(map(json.dumps, rows)) + "\nbroken{\n"), ("list", json.dumps(rows)), ("chain", json.dumps({"chain": rows}))):
        path = tmp_path / name
        path.write_text(text)
        assert sorted(map(tuple, files.ledger_lines(spark, str(path), BLOCK).collect())) == [(0, "a"), (1, "b")]


def test_generations_and_graphs(spark, tmp_path):
    people = spark.createDataFrame([(1, 2.0)], "uid int, fitness double")
    for g in (0, 1, 1):
        files.write_generation(people, g, str(tmp_path / "gen"))
    assert spark.read.parquet(str(tmp_path / "gen")).count() == 2
    files.write_graph(people, spark.createDataFrame([(1, 1)], "src int, dst int"), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "nodes")).first().fitness == 2.0
    files.write_json(people, str(tmp_path / "j"), one_file=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_port_graph(spark, tmp_path):
    body = {"version": "1", "nodes": [{"node_id": 1, "class": "Add", "ports": [{"name": "p", "target_node": 2, "target_port": "out"}]}, {"node_id": 2, "class": "Num", "value": "7", "ports": [{"name": "out", "target_node": 9, "target_port": "x"}]}]}
    (tmp_path / "g.json").write_text(json.dumps(body))
    nodes, wires = files.port_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and [tuple(r) for r in wires.collect()] == [(1, "p", 2, "out")]


def test_pdf_escapes_and_streams_that_cannot_be_inflated():
    plain = b"<< /Length 10 >>\nstream\n(line1\\nline2 \\050in\\51 \\q) Tj [(Array) (Text)] TJ\nendstream\n"
    broken = b"<< /Filter /FlateDecode >>\nstream\n(not shown) Tj\nendstream\n"
    assert files.pdf_text(plain + broken) == "line1\nline2 (in) q Array Text \n"
    assert files.pdf_text(b"no streams") == ""
    assert files.pdf_literal(rb"a\tb\\c") == "a\tb\\c"


def test_sources_with_patterns_and_a_report(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "sub/test_c.py", "d.rs", "venv/e.py"):
        (tmp_path / "lib" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / name).write_text("x = 1\n")
    sources = [{"path": str(tmp_path / "lib"), "exclude": ["test_*"]}, {"path": str(tmp_path / "lib") + "/sub", "language": "c", "include": ["*.py"], "target_mapping": "in"}, {"path": str(tmp_path / "gone")}]
    found, report = files.ingested(spark, sources)
    assert sorted((r.relative, r.destination) for r in found.collect()) == [("a.py", "imported/lib/a.py"), ("b.py", "in/b.py"), ("sub/b.py", "imported/lib/sub/b.py"), ("test_c.py", "in/test_c.py")]
    told = {r.source.rpartition("/")[2]: (r.files_ingested, r.bytes, r.error is None) for r in report.collect()}
    assert told == {"lib": (2, 12, True), "sub": (2, 12, True), "gone": (0, 0, False)}


def test_replay_ledger_is_written_bounded(spark, tmp_path):
    path = f"file://{tmp_path}/replay"
    row = lambda *x: spark.createDataFrame(list(x), "id long, action string, result double, params map<string,double>")
    files.record_replay(spark, path, row((1, "a", 0.5, {"x": 1.0}), (2, "a", float("nan"), None)), 2)
    files.record_replay(spark, path, row((3, "b", 0.9, None), (4, "b", 0.1, None)), 2)
    got = spark.read.schema("id long, result double, params map<string,double>").json(path)
    assert sorted((r.id, r.result, r.params) for r in got.collect()) == [(1, 0.5, {"x": 1.0}), (3, 0.9, None)]
    assert not (tmp_path / "replay._next").exists() and not (tmp_path / "replay._old").exists()


def test_port_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "Add", None), (2, "Num", "3"), (3, "Num", None)], "node_id long, cls string, value string")
    wires = spark.createDataFrame([(1, "left", 2, "out"), (1, "right", 9, "out"), (2, "out", 1, "left")], "src long, port string, dst long, dst_port string")
    path = f"file://{tmp_path}/graph"
    files.write_port_graph(nodes, wires, path)
    again, links = files.port_graph(spark, path)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, nodes.collect()), key=str)
    assert sorted(map(tuple, links.collect())) == [(1, "left", 2, "out"), (2, "out", 1, "left")]


def test_snapped_values(spark):
    from pyspark.sql import functions as F

    from factloom.operators.population import snapped

    rows = spark.createDataFrame([("a", ["a", "b"], "b"), ("x", ["a", "b"], "b"), ("x", ["a", "b"], "z"), ("x", [], "z"), ("x", None, "z")], "v string, c array<string>, d string")
    assert [r[0] for r in rows.select(snapped(F.col("v"), F.col("c"), F.col("d"))).collect()] == ["a", "b", "a", "x", "x"]


def test_ingest_of_several_languages(spark, tmp_path):
    from factloom.plans import pipelines

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f(): pass\n")
    (src / "b.c").write_text("struct P { int x; };\nint go(int a) { if (a) { return a; } return 0; } // note\n")
    (src / "c.cpp").write_text("struct Q { int y; };\nint run(int b) {\n /* other */ if (b) { return b; } return 0; }\n")
    rows = {r.path.rpartition("/")[2]: r for r in pipelines.ingest(spark, str(src), "ctx")[0].collect()}
    assert {n: (r.language, r.functions, r.types) for n, r in rows.items()} == {"a.py": ("python", ["f"], []), "b.c": ("c", ["go"], ["P"]), "c.cpp": ("cpp", ["run"], ["Q"])}
    assert rows["b.c"].semantic_hash == rows["c.cpp"].semantic_hash != rows["a.py"].semantic_hash
    assert [r.path.rpartition("/")[2] for r in pipelines.ingest(spark, str(src), "ctx", language="c")[0].collect()] == ["b.c"]
