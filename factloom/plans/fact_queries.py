"""Facts from texts, and the graph of their references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as O
from ..session import load
from .registry import Fixture, literal, of_parts, of_suppliers, query

PROSE = Fixture(
    "doc string, text string",
    [
        ("p1", "Let x@ be the patient's heart rate."),
        ("p2", "where rate denotes the mutation frequency"),
        ("p3", "x must remain between @ and 1@0 bpm."),
        ("p4", "Dosage must not exceed 5@ mg per day."),
        ("p5", "temp must remain below 9@. pressure must remain above 10."),
        ("p6", "The kinetic energy is given by E@ = 0.5 * m * v^2."),
        ("p7", "area = side * side"),
        ("p8", "line one\nline two\nLet y be the second-line variable.\n"),
        ("p9", ""),
        ("p10", "speed must be at least 3.@; x == 1"),
    ],
)
PROSE = of_parts(PROSE, "doc")
CODE = Fixture(
    "doc string, text string",
    [
        ("c1", "#define MAX_ENTITIES 10@"),
        ("c2", "const float GRAVITY = 9.@;"),
        ("c3", '#define VERSION "1.0.0"'),
        ("c4", "void tick() { assert(MAX_ENTITIES > 0); }"),
        ("c5", "const int DOUBLE_MAX = MAX_ENTITIES * 2;"),
        ("c6", "#define MAX 8\nconst float G = 9.5f;\nassert(G > MAX);\n"),
        ("c7", ""),
    ],
)
CODE = of_parts(CODE, "doc")
JSONS = Fixture(
    "doc string, text string",
    [
        ("j1", '{"state_variables":[{"symbol":"x@","description":"demo","bounds":[0,1]}]}'),
        ("j2", '{"constraints":[{"symbol":"x@","expression":"x@ > 0","variables":["x"]}]}'),
        ("j3", '{"equations":[{"lhs":"y","rhs":"x * 2","variables":["x"]}]}'),
        ("j4", '{"threshold":42,"name":"demo","nested":{"skip":true},"list":[1,2],"on":true,"rate":1.5}'),
        ("j5", "{not valid json"),
        ("j6", "[1, 2]"),
    ],
)
JSONS = of_parts(JSONS, "doc")

_PAIRS = "unnest(list_zip(regexp_extract_all(text, {p}, 1), regexp_extract_all(text, {p}, 2)))"


def _pairs(pattern: str, table: str) -> str:
    p = literal(pattern)
    return f"SELECT doc, m[1] AS a, m[2] AS b FROM (SELECT doc, {_PAIRS.format(p=p)} AS m FROM {table})"


@query(" UNION ALL ".join(f"SELECT doc, a AS symbol, trim(b) AS description FROM ({_pairs(p, PROSE.sql)})" for p in O.VARIABLES))
def prose_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.prose_variables(PROSE.frame(spark, sf_dir)).select("doc", "symbol", "description")


_B = literal(O.BETWEEN)


@query(
    f"SELECT doc, m[1] AS symbol, m[2] || ' <= ' || m[1] || ' <= ' || m[3] AS expression FROM (SELECT doc, unnest(list_zip(regexp_extract_all(text, {_B}, 1), regexp_extract_all(text, {_B}, 2), regexp_extract_all(text, {_B}, 3))) AS m FROM {PROSE.sql}) UNION ALL "
    + " UNION ALL ".join(f"SELECT doc, a AS symbol, a || ' {s} ' || b AS expression FROM ({_pairs(p, PROSE.sql)})" for s, p in O.BOUNDS)
)
def prose_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.prose_boundaries(PROSE.frame(spark, sf_dir)).select("doc", "symbol", "expression")


@query(
    f"SELECT doc, a AS symbol, a || ' = ' || trim(b) AS expression, array_to_string(list_filter(list_distinct(regexp_extract_all(trim(b), {literal(O.IDENT)})), lambda v: v <> a).list_sort(), ',') AS variables FROM ({_pairs(O.EQUATION, PROSE.sql)})"
)
def prose_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.prose_equations(PROSE.frame(spark, sf_dir)).select("doc", "symbol", "expression", F.array_join(F.array_sort("variables"), ",").alias("variables"))


@query(
    f"""WITH n AS ({_pairs(O.DEFINE, CODE.sql)} UNION ALL {_pairs(O.CONSTANT, CODE.sql)}),
k AS (SELECT doc, a AS symbol, trim(b) AS v, CASE WHEN regexp_matches(trim(b), {literal(O.C_STRING)}) THEN 'string' WHEN regexp_matches(trim(b), {literal(O.C_NUMBER)}) THEN CASE WHEN contains(trim(b), '.') THEN 'real' ELSE 'integer' END END AS type_hint FROM n)
SELECT doc, CASE WHEN type_hint IS NULL THEN 'equation' ELSE 'variable' END AS kind, symbol, type_hint, CASE WHEN type_hint IS NULL THEN symbol || ' = ' || v END AS expression, CASE WHEN type_hint IN ('real', 'integer') THEN regexp_replace(v, '[fFlL]+$', '')::DOUBLE END AS lo FROM k
UNION ALL SELECT doc, 'boundary', coalesce(regexp_extract_all(e, {literal(O.C_IDENT)})[1], 'assert'), NULL, e, NULL FROM (SELECT doc, unnest(regexp_extract_all(text, {literal(O.ASSERTION)}, 1)) AS e FROM {CODE.sql})"""
)
def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.c_facts(CODE.frame(spark, sf_dir)).select("doc", "kind", "symbol", "type_hint", "expression", "lo")


@query(
    JSONS.answers("(0, 'j1', 'variable', 'x@', 'unknown', NULL, 0.0::DOUBLE, 1.0::DOUBLE, 0.95::DOUBLE), (1, 'j2', 'boundary', 'x@', NULL, 'x@ > 0', NULL, NULL, 0.95), (2, 'j3', 'equation', 'y', NULL, 'y = x * 2', NULL, NULL, 0.95), (3, 'j4', 'variable', 'threshold', 'integer', NULL, 42.0, 42.0, 0.5), (3, 'j4', 'variable', 'name', 'string', NULL, NULL, NULL, 0.5), (3, 'j4', 'variable', 'on', 'boolean', NULL, NULL, NULL, 0.5), (3, 'j4', 'variable', 'rate', 'real', NULL, 1.5, 1.5, 0.5)", "n, doc, kind, symbol, type_hint, expression, lo double, hi double, confidence double")
)
def json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.json_facts(JSONS.frame(spark, sf_dir)).select("doc", "kind", "symbol", "type_hint", "expression", "lo", "hi", "confidence")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"SELECT doc, (length(substring(text, 1, position('Let ' IN text))) - length(replace(substring(text, 1, position('Let ' IN text)), chr(10), '')) + 1)::BIGINT AS line FROM {PROSE.sql} WHERE contains(text, 'Let ')")
def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.match_lines(PROSE.frame(spark, sf_dir), {"let": r"(?i)\blet\s+[A-Za-z]"}).select("doc", "line")


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts made of parts: a variable for each part, in the domain of its brand, named by its type;
    an equation for each brand over the types of all its parts."""
    part = load(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    variables = part.select(F.lit("variable").alias("kind"), F.col("p_brand").alias("domain"), F.col("p_type").alias("symbol"), F.col("p_partkey").alias("seq"), none.alias("variables"))
    equations = part.groupBy(F.col("p_brand").alias("domain")).agg(F.array_sort(F.collect_set("p_type")).alias("variables"))
    equations = equations.select(F.lit("equation").alias("kind"), "domain", F.concat(F.lit("sum_"), F.col("domain")).alias("symbol"), F.lit(0).cast("long").alias("seq"), "variables")
    return O.disambiguated(variables.unionByName(equations))


_FACTS = """WITH v AS (SELECT 'variable' AS kind, p_brand AS domain, p_type AS symbol, p_partkey AS seq FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY domain, symbol ORDER BY seq) AS nth FROM v),
u AS (SELECT kind, domain, symbol, seq, CASE WHEN nth = 1 THEN symbol ELSE symbol || '#' || nth END AS unique_symbol FROM n),
f AS (SELECT *, domain || '::' || unique_symbol AS fact_id FROM u)
"""


@query(_FACTS + "SELECT fact_id, seq FROM f")
def disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_facts(spark, sf_dir).where("kind = 'variable'").select("fact_id", "seq")


@query(_FACTS + "SELECT DISTINCT domain || '::sum_' || domain AS src, max_by(fact_id, seq) OVER (PARTITION BY domain, symbol) AS dst FROM f")
def ref_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reference_edges(part_facts(spark, sf_dir)).select("src", "dst")


@query(_FACTS + "SELECT a.fact_id AS src, b.fact_id AS dst, a.unique_symbol AS symbol FROM f a JOIN f b ON a.unique_symbol = b.unique_symbol AND a.domain <> b.domain")
def shared_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.shared_symbols(part_facts(spark, sf_dir)).select("src", "dst", "symbol")


@query(
    _FACTS
    + """SELECT 'node:variable' AS what, count(*)::BIGINT AS n FROM f
UNION ALL SELECT 'node:equation', count(DISTINCT domain) FROM f
UNION ALL SELECT 'edge:references', count(*) FROM (SELECT DISTINCT domain, symbol FROM f)
UNION ALL SELECT 'domains', count(DISTINCT domain) FROM f"""
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = part_facts(spark, sf_dir)
    return O.graph_statistics(facts, O.reference_edges(facts))


@query("SELECT domain, first_seq FROM (SELECT p_brand AS domain, min(p_partkey) AS first_seq FROM part GROUP BY 1)")
def distinct_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("domain")).agg(F.min("p_partkey").alias("first_seq"))


BROKEN = Fixture(
    "kind string, domain string, symbol string, expression string",
    [("variable", "d", "x@", None), ("boundary", "d", "b", None), ("equation", "", "e", "e = 1"), ("variable", "d", None, None), ("boundary", "d", "c", "c > 1")],
)
BROKEN = of_parts(BROKEN)


@query(
    f"SELECT kind, array_to_string(m, ',') AS missing FROM (SELECT kind, list_filter([CASE WHEN coalesce(symbol, '') = '' THEN 'symbol' END, CASE WHEN coalesce(domain, '') = '' THEN 'domain' END, CASE WHEN kind <> 'variable' AND coalesce(expression, '') = '' THEN 'expression' END], lambda x: x IS NOT NULL) AS m FROM {BROKEN.sql}) WHERE len(m) > 0"
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.violations(BROKEN.frame(spark, sf_dir)).select("kind", "missing")


LINKED = Fixture("fact_id string", [("bio::rate",), ("game::rate",), ("game::speed",)])
LINKED = of_suppliers(LINKED, "fact_id")
LINKS = Fixture("domain_a string, symbol_a string, domain_b string, symbol_b string, relation string", [("bio", "rate", "game", "rate", None), ("game", "speed", "bio", "rate", "drives")])
LINKS = of_suppliers(LINKS, "symbol_a", "symbol_b")


@query(f"SELECT domain_a || '::' || symbol_a AS src, domain_b || '::' || symbol_b AS dst, coalesce(relation, 'maps_to') AS edge_type FROM {LINKS.sql} WHERE domain_a || '::' || symbol_a IN (SELECT fact_id FROM {LINKED.sql}) AND domain_b || '::' || symbol_b IN (SELECT fact_id FROM {LINKED.sql})")
def linked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.linked_domains(LINKED.frame(spark, sf_dir), LINKS.frame(spark, sf_dir))
