"""Function scores of other languages, routing, symbols and counts of syntax, on fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states as S
from ..operators import code, routing
from ..streaming import routes as R
from .parsing_queries import PATHS
from .registry import Fixture, Spread, literal, of_suppliers, query

OTHERS = Fixture(
    "path string, text string",
    [
        ("d@/a.js", "function walk(n) {\n  for (let i = 0; i < n; i++) {\n    xs.push(walk(i));\n  }\n}\nconst add = (a, b) => a + b;\nadd(1, 2);\nadd(3, 4);\n"),
        ("d@/b.js", "while (true) {\n  if (x) {\n    y.map(f);\n  }\n}\n"),
        ("d@/c.js", "let x = 1;\n"),
        ("d@/d.rs", "pub fn norm(v: &[f64]) -> f64 {\n    let mut s = 0.0;\n    for x in v {\n        s += x * x;\n    }\n    s.sqrt()\n}\nfn go() {\n    std::thread::spawn(work);\n}\nfn down(n: u8) { if n > 0 { down(n - 1) } }\n"),
        ("d@/e.rs", "fn open("),
    ],
)
OTHERS = Spread(OTHERS, [], value="s_suppkey")

# a.js: braces to depth 2 in a loop, so 1; one push; walk calls itself, add is called twice (a call of its own name counts as recursion here).
# b.js: braces to 2, one map, no function. d.rs: norm has a loop (3), calls sqrt (0.2), 7 lines (0.35) and arithmetic (3); go is under 0; down calls itself.
_SCORES = "('d@/a.js', 'walk', 1::BIGINT, 1::BIGINT, true, 1::BIGINT, 9.7::DOUBLE), ('d@/a.js', 'add', 1, 1, true, 2, 9.9), ('d@/b.js', '<module>', 1, 1, false, 0, 4.5), ('d@/d.rs', 'norm', 1, 0, false, 1, 6.55), ('d@/d.rs', 'go', 0, 0, false, 1, 0.0), ('d@/d.rs', 'down', 0, 0, true, 1, 5.25)"


@query(OTHERS.answers(_SCORES, "path, function, depth long, ops long, recursive boolean, calls long, score double"))
def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.pattern_scores(OTHERS.frame(spark, sf_dir)).drop("span")


CODE = Fixture(
    "path string, text string",
    [
        ("d@/a.py", "import threading\nimport numpy as np\nfrom os import path\n\ndef spin():\n    t = threading.Thread(target=f)\n\ndef mean(xs):\n    return np.mean(xs)\n\ndef join(a):\n    return path.join(a, 'x')\n\nasync def pull(q):\n    await q.get()\n"),
        ("d@/b.py", "def gpu(x):\n    import torch\n    return x.cuda()\n\ndef guarded(lock):\n    with Lock():\n        return 1\n"),
        ("d@/c.rs", "fn raw(p: *mut u8) {\n    unsafe { *p = 1; }\n}\n\n\n\nfn view<'a>(s: &'a str) -> usize {\n    s.len()\n}\n\n\n\nfn plain(n: u8) -> u8 {\n    n + 1\n}\n"),
    ],
)
CODE = Spread(CODE, [], value="s_suppkey")


@query(
    CODE.answers("('d@/a.py', 'spin', 'threading', 6::BIGINT), ('d@/a.py', 'spin', 'external_dep', 6), ('d@/a.py', 'mean', 'external_dep', 9), ('d@/a.py', 'join', NULL, NULL), ('d@/a.py', 'pull', 'threading', 14), ('d@/a.py', 'pull', 'threading', 15), "
    "('d@/b.py', 'gpu', 'gpu', 2), ('d@/b.py', 'gpu', 'unsafe_pattern', 3), ('d@/b.py', 'guarded', 'threading', 6), ('d@/c.rs', 'raw', 'rust_memory', 2), ('d@/c.rs', 'view', 'rust_lifetime', 7), ('d@/c.rs', 'view', 'rust_lifetime', 7), ('d@/c.rs', 'plain', NULL, NULL)", "path, function, category, at_line long")
)
def routing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routing_reasons(CODE.frame(spark, sf_dir)).select("path", "function", "category", F.col("at").alias("at_line"))


@query(CODE.answers("('d@/a.py', 3::BIGINT, 1::BIGINT), ('d@/b.py', 2, 0), ('d@/c.rs', 2, 1)", "path, cold long, hot long"))
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.routes(routing.routing_reasons(CODE.frame(spark, sf_dir)))
    return rows.groupBy("path").agg(F.count_if("cold").alias("cold"), F.count_if(~F.col("cold")).alias("hot"))


@query(f"SELECT count(*)::BIGINT AS total_files, count(*) FILTER (density >= 5 AND NOT regexp_matches(path, {literal(S.COLD_NAMES)}))::BIGINT AS hot_paths, count(*) FILTER (density < 5 OR regexp_matches(path, {literal(S.COLD_NAMES)}))::BIGINT AS cold_paths FROM {PATHS.sql}")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PATHS.frame(spark, sf_dir)
    return routing.manifest(rows.select("path"), rows.select("path", S.path_class(F.col("path"), F.col("density")).alias("class")))


SYNTAX = Fixture(
    "file string, id bigint, parent bigint, language string, type string, kind string, text string",
    [
        ("a", 0, None, "python", "module", "translation_unit", None), ("a", 1, 0, "python", "function_definition", "function_declaration", None), ("a", 2, 1, "python", "block", None, None),
        ("a", 3, 1, "python", "identifier", None, "run"), ("a", 4, 2, "python", "identifier", None, "deep"), ("a", 5, 0, "python", "class_definition", "type_declaration", None),
        ("a", 6, 5, "python", "wrap", None, None), ("a", 7, 6, "python", "type_identifier", None, "K"), ("a", 8, 0, "python", "function_definition", "function_declaration", None),
        ("b", 0, None, "rust", "source_file", "translation_unit", None), ("b", 1, 0, "rust", "function_item", "function_declaration", None), ("b", 2, 1, "rust", "identifier", None, "go"),
        ("b", 3, 0, "rust", "function_item", "function_declaration", None), ("b", 4, 3, "rust", "identifier", None, "go"), ("c", 0, None, None, "odd", None, None),
    ],
)
SYNTAX = of_suppliers(SYNTAX, "file")


@query(SYNTAX.answers("('a', 'run', 'K'), ('b', 'go', ''), ('c', '', '')", "file, functions, types"))
def declared_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code.declared_symbols(SYNTAX.frame(spark, sf_dir))
    return rows.select("file", F.array_join("functions", ",").alias("functions"), F.array_join("types", ",").alias("types"))


@query(
    f"""WITH s AS {SYNTAX.sql}, e AS (SELECT CASE WHEN kind IS NULL THEN 'child' ELSE 'declares' END AS edge_type FROM s WHERE parent IS NOT NULL)
SELECT 'language' AS what, coalesce(language, 'unknown') AS name, count(*)::BIGINT AS n FROM s GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM s WHERE kind IS NOT NULL GROUP BY 2
UNION ALL SELECT 'edge', edge_type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'total', 'nodes', count(*) FROM s UNION ALL SELECT 'total', 'edges', count(*) FROM e"""
)
def syntax_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = SYNTAX.frame(spark, sf_dir)
    edges = rows.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.when(F.col("kind").isNull(), "child").otherwise("declares").alias("edge_type"))
    return code.syntax_totals(rows.select(F.struct("file", "id").alias("id"), "language", "kind"), edges)


REQUESTS = Fixture(
    "key string, seq bigint, at double, strategy string, score double, minimum double",
    [("k", 1, 0.0, "direct", 0.9, 0.5), ("k", 2, 1.0, "direct", 0.1, 0.5), ("k", 3, 2.0, "direct", 0.1, 0.5), ("k", 4, 3.0, "direct", 0.1, 0.5), ("k", 5, 302.0, "direct", 0.1, 0.5), ("j", 6, 3.0, "direct", 0.5, 0.5), ("j", 7, 4.0, "direct", 0.4, 0.5)],
)
REQUESTS = of_suppliers(REQUESTS, "key")


@query(REQUESTS.answers("('k', 1::BIGINT, 'direct', 0), ('k', 2, 'cached', 1), ('k', 3, 'reduced', 2), ('k', 4, 'restart', 2), ('k', 5, 'cached', 1), ('j', 6, 'direct', 0), ('j', 7, 'cached', 1)", "key, seq long, strategy, depth int"))
def fallback_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After 300 s a strategy may be taken again."""
    return R.routed(REQUESTS.frame(spark, sf_dir), ["cached", "reduced"], "restart")
