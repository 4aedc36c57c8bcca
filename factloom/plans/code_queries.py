"""Python source as data, on fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERNS
from ..operators import code as O
from .registry import Fixture, Spread, literal, of_suppliers, query

FILES = Fixture(
    "path string, text string",
    [
        ("d@/a.py", "import os\nimport sys as s\nMAX_RETRIES = 3\nRATE = 0.5\n\ndef area(radius):\n    return 3.14159 * radius * radius\n\ndef check(x):\n    assert x > 0\n    return x\n"),
        ("d@/b.py", "def fact(n):\n    if n < 2:\n        return 1\n    for i in range(3):\n        for j in range(2):\n            n = n + i * j\n    return n * fact(n - 1)\nprint(area(2), unknown)\n"),
        ("d@/c.py", "def (:"),
        ("d@/d.py", ""),
    ],
)
ALL = Spread(FILES, [], value="s_suppkey")


CODE = Fixture(
    "path string, text string",
    [
        ("d@/a.py", "MAX_RETRIES = 3\nA: int = 4\nB = None\nC: float\nNAME = 'x'\nRATE = 0.5\nON = True\nRAW = b'1'\nx.y = 1\np = q = 2\n"),
        ("d@/b.py", 'def area(r):\n    """Area."""\n    return 3.14159 * r * r\nasync def twice(x):\n    return x + x\ndef same(x):\n    return x\ndef none():\n    return\ndef two(x):\n    y = x\n    return y * 2\n'),
        ("d@/c.py", "def check(x):\n    assert x > 0\n    assert x\n    assert 1 < 2\n    return x\nclass K:\n    INNER = 5\n    def m(self):\n        return self.a + 1\n"),
        ("d@/d.py", "def (:"),
        ("d@/e.py", ""),
        ("d@/f.py", None),
    ],
)
CODE = Spread(CODE, [], value="s_suppkey")
_FACTS = (
    "('d@/a.py', 'variable', 'MAX_RETRIES', 'integer', NULL, '', 3.0::DOUBLE, 1::BIGINT), ('d@/a.py', 'variable', 'A', 'integer', NULL, '', 4.0, 2), ('d@/a.py', 'variable', 'NAME', 'string', NULL, '', NULL, 5), "
    "('d@/a.py', 'variable', 'RATE', 'real', NULL, '', 0.5, 6), ('d@/a.py', 'variable', 'ON', 'boolean', NULL, '', NULL, 7), ('d@/a.py', 'variable', 'RAW', 'unknown', NULL, '', NULL, 8), "
    "('d@/b.py', 'equation', 'area', NULL, 'area = 3.14159 * r * r', 'r', NULL, 1), ('d@/b.py', 'equation', 'twice', NULL, 'twice = x + x', 'x', NULL, 4), "
    "('d@/c.py', 'boundary', 'x', NULL, 'x > 0', 'x', NULL, 2), ('d@/c.py', 'boundary', 'assert_4', NULL, '1 < 2', '', NULL, 4), ('d@/c.py', 'equation', 'm', NULL, 'm = self.a + 1', 'self', NULL, 8)"
)


@query(CODE.answers(_FACTS, "path, kind, symbol, type_hint, expression, variables, value double, line long"))
def python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated and plain constants but None; docstrings and ``async`` make no difference."""
    return O.python_facts(CODE.frame(spark, sf_dir)).withColumn("variables", F.array_join("variables", ",")).drop("confidence")


SCORES = Fixture(
    "path string, text string",
    [
        ("d@/a.py", "def fib(n):\n    return fib(n - 1) + fib(n - 2)\n\ndef busy(xs):\n    out = []\n    for x in xs:\n        out.append([y for y in sorted(x)])\n    return out\n"),
        ("d@/b.py", "async def pull(q):\n    async for m in q:\n        while m:\n            m = m.next()\n\nclass A:\n    def run(self):\n        self.run()\n        helper(lambda: 0)()\n"),
        ("d@/c.py", "def (:"),
    ],
)
SCORES = Spread(SCORES, [], value="s_suppkey")


# fib: recursion 5, two calls 0.4, two lines 0.1. busy: a comprehension in a loop 6, append and sorted 3 and 0.4, five lines 0.25.
# pull: a loop (async for is none) 3, a call 0.2, four lines 0.2. run: calls itself by attribute 5, two named calls 0.4, three lines 0.15.
@query(
    SCORES.answers("('d@/a.py', 'fib', 0::BIGINT, 0::BIGINT, true, 2::BIGINT, 2::BIGINT, 5.5::DOUBLE), ('d@/a.py', 'busy', 2, 2, false, 2, 5, 9.65), ('d@/b.py', 'pull', 1, 0, false, 1, 4, 3.4), ('d@/b.py', 'run', 0, 0, true, 2, 3, 5.55)", "path, function, depth long, ops long, recursive boolean, calls long, span long, score double")
)
def function_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.function_scores(SCORES.frame(spark, sf_dir))


@query(SCORES.answers("('d@/a.py', 2::BIGINT, 15.15::DOUBLE, 9.65::DOUBLE), ('d@/b.py', 2, 8.95, 5.55)", "path, functions long, total double, hottest double"))
def file_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.file_density(O.function_scores(SCORES.frame(spark, sf_dir)))


@query(ALL.answers("('d@/b.py', 'area'), ('d@/b.py', 'unknown')", "path, name"))
def undefined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.undefined_names(O.name_roles(ALL.frame(spark, sf_dir)))


@query(ALL.answers("('d@/a.py', 'os'), ('d@/a.py', 's')", "path, name"))
def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.unused_imports(O.name_roles(ALL.frame(spark, sf_dir)))


USES = Spread(Fixture("path string, text string", [("d@/a.py", "def area@(r):\n    return r\n"), ("d@/b.py", "print(area@(2), unknown@)\n")]), [], value="s_suppkey")


@query(USES.answers("('d@/b.py', 'area@', 'd@/a.py')", "path, name, provider"))
def missing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.missing_imports(O.name_roles(USES.frame(spark, sf_dir)))


@query()
def syntax_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and depth of each file that parses; tested against a plain walk."""
    return O.syntax_nodes(ALL.frame(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


@query()
def syntax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.syntax_entropy(ALL.frame(spark, sf_dir))


def _starts(name: str, pattern: str, rank: int) -> str:
    """Starts of a pattern's matches: what is between them and they themselves, added up."""
    text = "text"
    if "(?!=)" in pattern:  # ``=`` but not ``==``, for an engine without look-ahead
        pattern, text = pattern.replace("(?!=)", ""), r"regexp_replace(text, '(^|[^:+\-*/|&^=])==', '\1' || chr(1) || chr(1), 'g')"
    p = literal("(?m)" + pattern)
    own = f"(SELECT path, regexp_split_to_array({text}, {p}) AS s, regexp_extract_all({text}, {p}) AS m FROM {ALL.sql})"
    before = "list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"SELECT path, {rank} AS rank, '{name}' AS token, unnest(list_transform(range(1, len(m) + 1), lambda i: ({before})::BIGINT)) AS start FROM {own}"


@query("SELECT path, (row_number() OVER (PARTITION BY path ORDER BY start, rank) - 1)::BIGINT AS n, start, token FROM (" + " UNION ALL ".join(_starts(k, p, r) for r, (k, p) in enumerate(TOKEN_PATTERNS.items())) + ")")
def token_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.token_sequence(ALL.frame(spark, sf_dir))


_LEX = literal(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|\"[^\"\n]*\"|'[^'\n]*'|[^\s\w]")


@query(
    f"""WITH t AS (SELECT path, unnest(m) AS text, (generate_subscripts(m, 1) - 1)::BIGINT AS n FROM (SELECT path, regexp_extract_all(text, {_LEX}) AS m FROM {ALL.sql}))
SELECT path, n, CASE WHEN regexp_matches(text, '^[A-Za-z_]') THEN 'identifier' WHEN regexp_matches(text, '^[0-9]') THEN 'number' WHEN text[1] IN ('"', chr(39)) THEN 'string' ELSE 'punctuation' END AS kind, text,
greatest(0, coalesce(sum((text IN ('(', '[', '{{'))::INT) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - sum((text IN (')', ']', '}}'))::INT) OVER (PARTITION BY path ORDER BY n))::BIGINT AS depth FROM t"""
)
def lexical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.lexical_tokens(ALL.frame(spark, sf_dir))


BODIES = Fixture("path string, name string, body string", [("a", "f", "return  1"), ("b", "f", "return 1"), ("c", "f", "return 2"), ("a", "g", "pass"), ("a", "g", "pass")])
BODIES = of_suppliers(BODIES, "name")


@query(f"SELECT name, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM {BODIES.sql} GROUP BY name, regexp_replace(body, '\\s+', ' ', 'g') HAVING count(DISTINCT path) >= 2")
def consolidated_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.consolidated(BODIES.frame(spark, sf_dir)).select("name", F.array_join("files", ",").alias("files"))
