"""Metrics, verdicts, diagnostics, and code relations, on fixtures and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states as S
from ..operators import parsing as O
from ..session import load
from .registry import Fixture, Spread, literal, of_parts, of_suppliers, query

OUT = Fixture(
    "id int, out string, code int",
    [
        (1, "wall_time=0.@", 0),
        (2, '{"wall_time": 1.@, "energy": 0.9}', 0),
        (3, '{"wall_time": 2.5, "energy": 1.2, "accuracy_error": 0.001}', 0),
        (4, 'noise {"energy": @} tail\naccuracy: 1e-3', 1),
        (5, "nothing", 3),
    ],
)
OUT = of_parts(OUT, "id")


_JSON = f"SELECT id, out, CASE WHEN json_valid(trim(out)) THEN trim(out) WHEN json_valid(regexp_extract(out, '(?s)(\\{{.*\\}})', 1)) THEN regexp_extract(out, '(?s)(\\{{.*\\}})', 1) END AS j FROM {OUT.sql}"
_VALUE = lambda k: f"TRY_CAST(json_extract_string(j, '$.{k}') AS DOUBLE)"
_LINE = lambda k: f"TRY_CAST(nullif(regexp_extract(out, '(?i){k}\\s*[=:]\\s*({O.NUMBER})', 1), '') AS DOUBLE)"


@query(f"SELECT id, coalesce({_VALUE('wall_time')}, {_LINE('wall_time')}) AS wall_time, coalesce({_VALUE('energy')}, {_LINE('energy')}) AS energy, coalesce({_VALUE('accuracy_error')}, {_VALUE('accuracy')}, {_LINE('accuracy')}) AS accuracy FROM ({_JSON})")
def metric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.parsed_metrics(OUT.frame(spark, sf_dir)).select("id", "wall_time", "energy", "accuracy")


RUNS = Fixture(
    "id int, out string, code int",
    [(1, "gravity_@: PASS\ncollision: FAIL\norbital: OK", 0), (2, "nbody error=@e-12\nmetric error=5e-7", 0), (3, "no cases here", 0), (4, "", 2), (5, "a.b/c = ok\n", 1)],
)
RUNS = of_parts(RUNS, "id")
_LINES = f"SELECT id, unnest(string_split(out, chr(10))) AS line FROM {RUNS.sql}"
_CASES = f"""SELECT id, CASE WHEN v <> '' THEN regexp_extract(line, {literal(O.VERDICT)}, 1) ELSE regexp_extract(line, {literal(O.ERROR)}, 1) END AS name,
CASE WHEN v <> '' THEN upper(v) IN ('PASS', 'OK') ELSE abs(e) <= 1e-8 END AS passed FROM (SELECT *, regexp_extract(line, {literal(O.VERDICT)}, 2) AS v, TRY_CAST(regexp_extract(line, {literal(O.ERROR)}, 2) AS DOUBLE) AS e FROM ({_LINES}))"""


@query(f"SELECT * FROM ({_CASES}) WHERE passed IS NOT NULL")
def validation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.validation_cases(RUNS.frame(spark, sf_dir), tolerance=1e-8).select("id", "name", "passed")


@query(f"SELECT r.id, count(passed)::BIGINT AS cases, coalesce(sum((NOT passed)::INT), 0)::BIGINT AS failed, CASE WHEN count(passed) > 0 THEN bool_and(passed) ELSE max(code) = 0 END AS passed FROM {RUNS.sql} r LEFT JOIN (SELECT * FROM ({_CASES}) WHERE passed IS NOT NULL) c ON c.id = r.id GROUP BY 1")
def validation_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.validation_reports(RUNS.frame(spark, sf_dir), tolerance=1e-8)


PRODUCED = Fixture("id int, out string", [(1, "1.@ 2.0 3.0"), (2, "1.1 x 2.@"), (3, "5e2 7"), (4, "none")])
PRODUCED = of_parts(PRODUCED, "id")
REFERENCE = Fixture("id int, out string", [(1, "1.0 2.0 3.0"), (2, "1.0 2.0 9.0"), (3, "4@ 0"), (4, "1.0")])
REFERENCE = of_parts(REFERENCE, "id")


_NUMBERS = f"regexp_extract_all({{}}.out, {literal(O.NUMBER)})"


@query(
    f"""WITH z AS (SELECT p.id, unnest(list_zip({_NUMBERS.format('p')}, {_NUMBERS.format('r')}, true)) AS z FROM {PRODUCED.sql} p JOIN {REFERENCE.sql} r ON r.id = p.id),
n AS (SELECT id, z[1]::DOUBLE AS got, z[2]::DOUBLE AS ref FROM z)
SELECT id, round(max(abs(got - ref) / CASE WHEN abs(ref) > 1e-30 THEN abs(ref) ELSE 1.0 END), 9) AS max_error FROM n GROUP BY 1"""
)
def accuracy_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.positional_error(PRODUCED.frame(spark, sf_dir), REFERENCE.frame(spark, sf_dir)).withColumn("max_error", F.round("max_error", 9))


RECORDS = Fixture(
    "id int, record map<string,double>, success boolean",
    [(1, {"accuracy": 0.9, "latency_ms": 500.0}, None), (2, {"wall_seconds": 0.0, "compression": 0.4}, True), (3, {"score": -1.0, "wall_us": 2e6}, False), (4, {"precision": 0.5, "accuracy_score": 0.7, "execution_time": -3.0}, None)],
)
RECORDS = of_parts(RECORDS, "id")


@query(RECORDS.answers("(0, 1, 0.9::DOUBLE, 2.0::DOUBLE, 0.0::DOUBLE), (1, 2, 1.0, 1e9, 0.4), (2, 3, 0.0, 0.5, 0.0), (3, 4, 0.7, 0.0, 0.0)", "n, id int, accuracy_score double, inverse_wall_seconds double, compression_ratio double"))
def objective_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.objective_vector(RECORDS.frame(spark, sf_dir)).select("id", "accuracy_score", "inverse_wall_seconds", "compression_ratio")


@query("SELECT '[' || json_keys(props)[1] || ']' AS fields, count(*)::BIGINT AS n FROM events GROUP BY 1 HAVING count(*) >= 2")
def hotpath_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return O.hot_groups(rows, "m").select(F.concat(F.lit("["), F.col("label"), F.lit("]")).alias("fields"), F.col("weight").alias("n"))


KV = Fixture("path string, text string", [("a", "KEY=@\nnot a pair\n  OTHER_KEY=two words  "), ("b", "KEY=1\nKEY=2\nlow=3"), ("c", ""), ("d", "A=b=c")])
KV = of_parts(KV, "path")


@query(
    f"""WITH l AS (SELECT path, trim(unnest(string_split(text, chr(10)))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {KV.sql}),
k AS (SELECT path, regexp_extract(x, '^([A-Z_][A-Z0-9_]*)=', 1) AS key, arg_max(regexp_extract(x, '^[A-Z_][A-Z0-9_]*=(.+)$', 1), i) AS value FROM l WHERE regexp_matches(x, '^[A-Z_][A-Z0-9_]*=.+$') GROUP BY 1, 2)
SELECT f.path, coalesce(string_agg(key || '=' || value, ';' ORDER BY key || '=' || value), '') AS fields FROM {KV.sql} f LEFT JOIN k ON k.path = f.path GROUP BY 1"""
)
def key_value_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array_sort(F.transform(F.map_entries(O.key_values(F.col("text"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return KV.frame(spark, sf_dir).select("path", F.array_join(pairs, ";").alias("fields"))


ERRORS = Fixture("id int, out string", [(1, "error[E0599]: no method named `neg_@` found for reference `&rug::Integer` in the current scope"), (2, "error[E0432]: unresolved import `a::b`\nerror[E0432]: unresolved import `c`"), (3, "fine")])
ERRORS = of_parts(ERRORS, "id")


_METHOD, _UNRESOLVED = literal(O.METHOD), literal(O.UNRESOLVED)


@query(
    f"""WITH m AS (SELECT id, unnest(list_zip(regexp_extract_all(out, {_METHOD}, 1), regexp_extract_all(out, {_METHOD}, 2))) AS m FROM {ERRORS.sql})
SELECT id, 'method_not_found' AS kind, m[1] AS name, regexp_replace(regexp_replace(m[2], '^(&|mut\\s+|\\s)+', ''), '<.*$', '') AS receiver FROM m
UNION ALL SELECT id, 'unresolved_import', unnest(regexp_extract_all(out, {_UNRESOLVED}, 1)), NULL FROM {ERRORS.sql}"""
)
def rust_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rust_diagnoses(ERRORS.frame(spark, sf_dir))


CAUSES = Fixture(
    "id int, out string, declared map<string,string>, locked map<string,string>",
    [
        (1, "no method named `neg_@` found for reference `&rug::Integer` in the current scope", {"rug": "1.0"}, {"rug": "1.24.1"}),
        (2, "no method named `go` found for struct `Wave<f64>`\nunresolved import `serde`", {"my-crate": "2"}, {"my-crate": "2.0.3"}),
        (3, "no method named `x` found for mutable reference `&mut my_crate::T<u8>`", {"my-crate": "2", "rug": "1"}, {}),
        (4, "unresolved import `tokio_util::io`", {"tokio_util": "0.7"}, {"tokio-util": "0.7.1"}),
        (5, "no method named `x` found for struct `T`", {"a": "1", "b": "2"}, {}),
        (6, "fine", {}, {}),
    ],
)
CAUSES = of_parts(CAUSES, "id")


@query(
    CAUSES.answers("(0, 1, 'method_not_found', 'neg_@', 'rug::Integer', 'rug', '1.24.1', '1.0'), (1, 2, 'method_not_found', 'go', 'Wave', 'my-crate', '2.0.3', '2'), (2, 3, 'method_not_found', 'x', 'my_crate::T', 'my-crate', NULL, '2'), "
    "(3, 4, 'unresolved_import', NULL, 'tokio_util::io', 'tokio_util', NULL, '0.7'), (4, 5, 'method_not_found', 'x', 'T', '', NULL, NULL)", "n, id int, kind, name, receiver, crate, resolved_version, declared_version")
)
def rust_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rust_root_causes(CAUSES.frame(spark, sf_dir))


LOCK = Fixture("id int, text string", [(1, '[[package]]\nname = "rug"\nversion = "1.@.1"\n\n[[package]]\nname = "az"\nversion = "1.2"\nsource = "x"\n'), (2, "version = 3")])
LOCK = of_parts(LOCK, "id")


@query(
    f"""WITH p AS (SELECT id, unnest(list_zip(regexp_extract_all(text, '(?s)name = "([^"]+)"', 1), regexp_extract_all(text, '(?s)version = "([^"]+)"', 1))) AS p FROM {LOCK.sql})
SELECT f.id, coalesce(string_agg(p[1] || '=' || p[2], ';' ORDER BY p[1]), '') AS versions FROM {LOCK.sql} f LEFT JOIN p USING (id) GROUP BY f.id"""
)
def locked_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_sort(F.transform(F.map_entries(O.locked_versions(F.col("text"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return LOCK.frame(spark, sf_dir).select("id", F.array_join(shown, ";").alias("versions"))


_SPAN = '{{"file_name":"{}","byte_start":{},"byte_end":{},"line_start":{},"column_start":{},"is_primary":{}}}'
MESSAGES = Fixture(
    "id int, out string",
    [
        (1, '{"$message_type":"diagnostic","message":"cannot assign twice to immutable variable `x@`","code":{"code":"E0384"},"level":"error","spans":[' + _SPAN.format("z.rs", 1, 2, 3, 4, "false") + "," + _SPAN.format("a.rs", 21, 22, 1, 5, "true") + ']}\n{"$message_type":"diagnostic","message":"aborting due to 1 previous error","level":"error","spans":[]}\nnoise'),
        (2, '{"message":"meh","level":"warning","code":null,"spans":[' + _SPAN.format("b.rs", 1, 2, 1, 1, "true") + "]}"),
        (3, '{"$message_type":"artifact","message":"x","spans":[' + _SPAN.format("c.rs", 1, 2, 1, 1, "true") + "]}"),
        (4, '{"message":"no level","spans":[' + _SPAN.format("d.rs", 7, 9, 2, 3, "false") + "]}"),
        (5, '{"reason":"compiler-message","message":{"level":"error","message":"wrapped","code":{"code":"E0433"},"spans":[' + _SPAN.format("e.rs", 1, 2, 8, 1, "true") + "]}}"),
        (6, '[{"kind":"error","message":"expected \';\' before \'}\' token","option":"-Werror","locations":[{"caret":{"file":"f.c","line":3,"column":12,"byte-column":12},"finish":{"byte-column":14}}]},{"kind":"warning","message":"unused"}]\n[{"message":"bare"}]'),
        (7, "not json"),
    ],
)
MESSAGES = of_parts(MESSAGES, "id")
_AT = lambda path, of="j": f"json_extract_string({of}, '$.{path}')"
_RUST = f"""l AS (SELECT id, unnest(string_split(out, chr(10))) AS raw FROM {MESSAGES.sql}),
r AS (SELECT id, raw::JSON AS j FROM l WHERE starts_with(raw, '{{') AND json_valid(raw)),
u AS (SELECT id, CASE WHEN {_AT('reason')} = 'compiler-message' THEN json_extract(j, '$.message') ELSE j END AS j FROM r),
p AS (SELECT id, j, json_extract(j, '$.spans[*]') AS spans FROM u WHERE coalesce({_AT('"$message_type"')}, 'diagnostic') = 'diagnostic'),
s AS (SELECT id, j, coalesce(list_filter(spans, lambda x: {_AT('is_primary', 'x')} = 'true')[1], spans[1]) AS s FROM p)"""


@query(
    f"""WITH {_RUST}, g AS (SELECT id, unnest(json_extract(raw::JSON, '$[*]')) AS j FROM l WHERE starts_with(raw, '[') AND json_valid(raw))
SELECT id, 'rustc' AS source, coalesce({_AT('level')}, 'error') AS level, {_AT('code.code')} AS code, {_AT('message')} AS message, {_AT('file_name', 's')} AS file, ({_AT('line_start', 's')})::INT AS line, ({_AT('column_start', 's')})::INT AS column,
({_AT('byte_start', 's')})::BIGINT AS start_byte, ({_AT('byte_end', 's')})::BIGINT AS end_byte FROM s WHERE s IS NOT NULL AND coalesce({_AT('level')}, 'error') = 'error'
UNION ALL SELECT id, 'gcc', coalesce({_AT('kind')}, 'error'), {_AT('option')}, coalesce({_AT('message')}, ''), coalesce({_AT('locations[0].caret.file')}, ''), coalesce(({_AT('locations[0].caret.line')})::INT, 1), coalesce(({_AT('locations[0].caret.column')})::INT, 1),
({_AT('locations[0].caret."byte-column"')})::BIGINT, ({_AT('locations[0].finish."byte-column"')})::BIGINT FROM g WHERE coalesce({_AT('kind')}, 'error') = 'error'"""
)
def compiler_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of either compiler: the primary span's or the first caret's place; what has no span is left out."""
    return O.compiler_messages(MESSAGES.frame(spark, sf_dir))


DIAGNOSES = Fixture(
    "id int, code string, message string",
    [
        (1, "E0432", "x"), (2, "E0384", "x"), (3, None, '"foo" is not defined'), (4, None, "cannot assign twice to immutable variable `x`"), (5, None, "expected one of `.`, `;`, `?` ... found keyword `let`"),
        (6, "E9999", "some random error"), (7, None, "#[pymodule] cannot import glob statements"), (8, "e0433", "x"), (9, None, "the name `A` is defined multiple times"), (10, "E0432", "unresolved import `super::inner`"),
        (11, "E0308", "expected `&[f64]`, found `&[[f64; 3]]`"), (12, "E0308", "mismatched types"), (13, "reportMissingImports", "x"), (14, None, "cannot borrow `x` as mutable"), (15, None, "expected ';' before return"), (16, "expected_semicolon", "x"),
    ],
)
DIAGNOSES = of_parts(DIAGNOSES, "id")


@query(
    DIAGNOSES.answers(
        "(0, 1, 'missing_import'), (1, 2, 'immutable_assignment'), (2, 3, 'missing_import'), (3, 4, 'immutable_assignment'), (4, 5, 'missing_semicolon'), (5, 6, NULL), (6, 7, 'pyo3_glob_import'), (7, 8, 'missing_crate'), (8, 9, 'duplicate_definition'), (9, 10, 'unresolved_parent_import'), (10, 11, 'mismatched_slice_type'), (11, 12, NULL), (12, 13, 'missing_import'), (13, 14, 'immutable_assignment'), (14, 15, 'missing_semicolon'), (15, 16, 'missing_semicolon')",
        "n, id int, category",
    )
)
def diagnosis_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.diagnosis_categories(DIAGNOSES.frame(spark, sf_dir)).select("id", "category")


NAMES = Fixture("name string", [(x,) for x in ("cpp_core@", "python_dashboard@", "rust_engine@", "solver@_f90", "thing@", "my_panel@", "clang_tool@")])
NAMED = Spread(NAMES, [], value="s_suppkey")


@query(NAMED.answers("('cpp_core@', 'cpp', 'core'), ('python_dashboard@', 'python', 'binding'), ('rust_engine@', 'rust', 'core'), ('solver@_f90', 'fortran', 'core'), ('thing@', 'python', 'binding'), ('my_panel@', 'python', 'binding'), ('clang_tool@', 'c', 'core')", "name, language, role"))
def target_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.inferred_targets(NAMED.frame(spark, sf_dir))


FOUND = Fixture("path string", [(f"k@/{p}",) for p in ("core/solver.cpp", "core/solver.h", "src/thing/a.rs", "src/thing/b.rs", "src/thing/c.cpp", "other.f90", "readme.md")])
FOUND = Spread(FOUND, [], value="s_suppkey")


@query("SELECT * FROM (VALUES ('thing', 'rust', 'core'), ('my_other', 'fortran', 'core'), ('solver', 'cpp', 'core'), ('nothing_here', 'python', 'binding'), ('rust_thing', 'rust', 'core')) t(name, language, role)")
def target_languages_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without a hint go by the most frequent language of their files."""
    names = spark.createDataFrame([("thing",), ("my_other",), ("solver",), ("nothing_here",), ("rust_thing",)], "name string")
    return O.inferred_targets(names, FOUND.frame(spark, sf_dir))


#: Targets of every nation: a configuration, as each core is offered to each binding.
OFFERED = Spread(NAMES, [], "nation", "n_nationkey", "n_nationkey")


@query(
    "SELECT replace(p, '@', x.n_nationkey::VARCHAR) AS provider, replace(c, '@', y.n_nationkey::VARCHAR) AS consumer, m AS mechanism FROM nation x, nation y, (VALUES ('cpp_core@', 'pybind11'), ('rust_engine@', 'pyo3'), ('solver@_f90', 'ctypes'), ('clang_tool@', 'ctypes')) a(p, m), (VALUES ('python_dashboard@'), ('thing@'), ('my_panel@')) b(c)"
)
def ffi_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.boundaries(O.inferred_targets(OFFERED.frame(spark, sf_dir)))


@query("SELECT DISTINCT p_partkey AS call, name FROM part, (VALUES ('blue'), ('ed'), ('green a'), ('zz'), ('part')) n(name) WHERE contains(p_name, name)")
def call_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("call"), F.col("p_name").alias("text"))
    names = spark.createDataFrame([("blue",), ("ed",), ("green a",), ("zz",), ("part",)], "name string")
    return O.call_bridges(calls, names)


@query("WITH d AS (SELECT l_suppkey, max_by(l_orderkey * 8 + l_linenumber, (l_shipdate, l_orderkey * 8 + l_linenumber)) AS def_id FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT 's' || l_suppkey AS name, def_id, count(*)::BIGINT AS uses FROM lineitem JOIN d USING (l_suppkey) WHERE l_returnflag = 'R' GROUP BY 1, 2")
def def_use_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("name", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    rows = rows.withColumn("seq", F.struct("l_shipdate", "id"))
    return O.def_use(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'")).groupBy("name", "def_id").agg(F.count("*").alias("uses"))


PRECISION = Fixture(
    "file string, seq int, is_call boolean, name string, text string",
    [("a", 1, True, "print", "print(x)"), ("a", 2, True, "Exp", "exp(x)"), ("a", 3, True, "solve", "solve(a)"), ("b", 1, False, "run_newton", ""), ("c", 1, True, "f", "det(m)"), ("d", 1, False, "exp", "x"), ("e", 1, True, "inv", "y")],
)
PRECISION = of_suppliers(PRECISION, "file")


@query(PRECISION.answers("('a', 'transcendental call ''exp'' accumulates rounding error'), ('b', 'iterative solver pattern is sensitive to precision'), ('c', 'linear-algebra op may be ill-conditioned')", "file, reason"))
def precision_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.precision_advice(PRECISION.frame(spark, sf_dir))


SYNTAX = Fixture(
    "file string, seq int, language string, type string, named boolean",
    [("a", k, "python", t, n) for k, (t, n) in enumerate([("module", True), ("function_definition", True), ("def", False), ("identifier", True), ("(", False), ("comment", True), ("integer", True), ("if_statement", True), ("call_expression", True), ("type", True), ("odd", True), ("ERROR", True)])]
    + [("b", 0, "rust", "function_item", True), ("b", 1, "rust", "line_comment", True), ("b", 2, "rust", "mod_item", True)],
)
SYNTAX = of_suppliers(SYNTAX, "file")


@query(SYNTAX.answers("('a', 0, 'MODULE'), ('a', 1, 'DECLARATION'), ('a', 2, 'KEYWORD'), ('a', 3, 'IDENTIFIER'), ('a', 4, 'PUNCTUATION'), ('a', 5, 'COMMENT'), ('a', 6, 'LITERAL'), ('a', 7, 'STATEMENT'), ('a', 8, 'EXPRESSION'), ('a', 9, 'TYPE'), ('a', 10, 'UNKNOWN'), ('a', 11, 'ERROR'), ('b', 0, 'DECLARATION'), ('b', 1, 'COMMENT'), ('b', 2, 'DECLARATION')", "file, seq int, category"))
def node_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = S.node_category(F.col("language"), F.col("type"), F.col("named"), F.lit(False))
    return SYNTAX.frame(spark, sf_dir).select("file", "seq", category.alias("category"))


@query(SYNTAX.answers("('a', sha256('translation_unit|function_declaration|identifier|integer|if_statement|call_expression|type|odd|ERROR')), ('b', sha256('function_declaration|module_declaration'))", "file, hash"))
def uast_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.semantic_hashes(SYNTAX.frame(spark, sf_dir))


PATHS = Fixture("path string, density double", [("src@/hot.py", 7.5), ("src@/settings.py", 9.0), ("a@/Cargo.toml", 8.0), ("ui@/template.js", 6.0), ("src@/slow.py", 4.9), ("edge@.rs", 5.0)])
PATHS = Spread(PATHS, [], "part", "p_partkey", "p_partkey", one=True)


@query(f"SELECT path, CASE WHEN density >= 5 AND NOT regexp_matches(path, {literal(S.COLD_NAMES)}) THEN 'hot' ELSE 'cold' END AS class FROM {PATHS.sql}")
def hot_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PATHS.frame(spark, sf_dir).select("path", S.path_class(F.col("path"), F.col("density")).alias("class"))


SPANS = Fixture("file string, id int, type string, start int, stop int", [("a", 1, "function", 0, 100), ("a", 2, "if", 10, 20), ("a", 3, "for", 30, 60), ("a", 4, "if", 40, 50), ("a", 5, "function", 200, 300), ("b", 6, "function", 0, 50), ("b", 7, "while", 5, 9)])
SPANS = of_suppliers(SPANS, "file", "id")


@query(f"SELECT f.id AS function, (count(b.id) + 1)::BIGINT AS complexity FROM {SPANS.sql} f LEFT JOIN {SPANS.sql} b ON b.file = f.file AND b.type IN ('if', 'for', 'while') AND b.start >= f.start AND b.stop <= f.stop WHERE f.type = 'function' GROUP BY 1")
def cyclomatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.branch_counts(SPANS.frame(spark, sf_dir), ["if", "for", "while"])


TESTS = Fixture("id int, out string", [(1, "=== @ passed, 3 failed in 2s ==="), (2, "7 passed"), (3, "error")])
TESTS = of_parts(TESTS, "id")


@query(f"SELECT id, coalesce(TRY_CAST(regexp_extract(out, '(\\d+) passed', 1) AS BIGINT), 0) AS passed, coalesce(TRY_CAST(regexp_extract(out, '(\\d+) failed', 1) AS BIGINT), 0) AS failed FROM {TESTS.sql}")
def test_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TESTS.frame(spark, sf_dir).select("id", O.test_counts(F.col("out")).alias("c")).select("id", "c.*")


@query("WITH r AS (SELECT c_custkey, 'acct' AS origin, c_acctbal AS value FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 'order', max(o_totalprice) FROM orders GROUP BY 1) SELECT c_custkey, origin, value FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE origin WHEN 'order' THEN 0 ELSE 1 END) AS k FROM r) WHERE k = 1")
def objective_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that has a customer's value."""
    acct = load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.lit("acct").alias("origin"), F.col("c_acctbal").alias("value"))
    order = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("value")).select("c_custkey", F.lit("order").alias("origin"), "value")
    return O.best_source(acct.unionByName(order), "c_custkey", {"order": 0, "acct": 1})


IMPORTS = Fixture("file string, module string", [("p@/pkg/a.py", ".b"), ("p@/pkg/a.py", "p@.pkg.sub"), ("p@/pkg/sub/c.py", "..a"), ("p@/pkg/a.py", "os"), ("p@/main.py", "p@.pkg.b"), ("p@/pkg/a.py", ".")])
IMPORTS = Spread(IMPORTS, [], value="s_suppkey")
TREE = Fixture("path string", [(p,) for p in ("p@/pkg/a.py", "p@/pkg/b.py", "p@/pkg/sub/__init__.py", "p@/pkg/sub/c.py", "p@/main.py")])
TREE = Spread(TREE, [], value="s_suppkey")


@query(IMPORTS.answers("('p@/pkg/a.py', '.b', 'p@/pkg/b.py'), ('p@/pkg/a.py', 'p@.pkg.sub', 'p@/pkg/sub/__init__.py'), ('p@/pkg/sub/c.py', '..a', 'p@/pkg/a.py'), ('p@/main.py', 'p@.pkg.b', 'p@/pkg/b.py')", "file, module, target"))
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.resolved_imports(IMPORTS.frame(spark, sf_dir), TREE.frame(spark, sf_dir))


FRAMES = Fixture(
    "id int, frame string",
    [
        (1, 'Content-Length: 9\r\n\r\n{"method":"textDocument/publishDiagnostics","params":{"uri":"file:///w/a.rs","diagnostics":[{"severity":1,"code":"E0432","message":"unresolved import `x@::y`"},{"severity":3,"code":"E0432","message":"hint"},{"code":"odd","message":"no"}]}}'),
        (2, '{"method":"other","params":{}}'),
        (3, "broken"),
    ],
)
FRAMES = of_parts(FRAMES, "id")


@query(FRAMES.answers("(0, 1, 'fix_import', 'E0432', 'x@::y', '/w/a.rs')", "n, id int, action, code, symbol, file"))
def editor_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.editor_commands(FRAMES.frame(spark, sf_dir), {"E0432": "fix_import"})
