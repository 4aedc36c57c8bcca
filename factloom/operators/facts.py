"""Facts from prose, JSON and C-like code, and the graph that they form.

Extractors return rows (doc, kind, symbol, description, expression, variables, lo, hi,
type_hint, confidence); a document without facts gives none. All but line numbers are
built-in functions; line numbers need match offsets, which come from an Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENT = r"[A-Za-z][A-Za-z0-9_]*"
NUMBER = r"\d+(?:\.\d+)?"

# Cue phrases. Groups are (symbol, text) or (symbol, bounds).
EQUATION = rf"({IDENT})\s*=\s*((?:\d+\.\d+|[^.\n;])+)"
VARIABLES = [rf"(?i)\blet\s+({IDENT})\s+be\s+([^.,;\n]+)", rf"(?i)\bwhere\s+({IDENT})\s+(?:denotes|represents|is)\s+([^.,;\n]+)"]
BETWEEN = rf"(?i)({IDENT})\s+must\s+(?:remain\s+|be\s+)?between\s+({NUMBER})\s+and\s+({NUMBER})"
BOUNDS = [
    ("<=", rf"(?i)({IDENT})\s+must\s+not\s+exceed\s+({NUMBER})"),
    ("<", rf"(?i)({IDENT})\s+must\s+(?:remain\s+|be\s+)?(?:below|under)\s+({NUMBER})"),
    (">", rf"(?i)({IDENT})\s+must\s+(?:remain\s+|be\s+)?(?:above|over|at\s+least)\s+({NUMBER})"),
]
DEFINE = r"(?m)^\s*#\s*define\s+([A-Za-z_]\w*)\s+(\S.*)$"
CONSTANT = r"\bconst\s+[\w:<>]+\s+([A-Za-z_]\w*)\s*=\s*([^;]+);"
ASSERTION = r"\bassert\s*\(\s*([^;]+?)\s*\)\s*;"
C_IDENT = r"[A-Za-z_]\w*"
C_NUMBER = r"^-?\d+(\.\d+)?[fFlL]?$"
C_STRING = r'^"(.*)"$'

COLUMNS = ["doc", "kind", "symbol", "description", "expression", "variables", "lo", "hi", "type_hint", "confidence"]


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All matches of a pattern, as an array of structs of its first n groups, g0 the whole."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(n + 1)])


def _matches(docs: DataFrame, pattern: str, n: int) -> DataFrame:
    return docs.select("doc", F.explode(_groups(F.col("text"), pattern, n)).alias("m")).select("doc", *[F.col(f"m.g{k}").alias(f"g{k}") for k in range(n + 1)])


def _strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _fact(kind: str, confidence: float | Column, **columns: Column) -> list[Column]:
    given = {"doc": F.col("doc"), "kind": F.lit(kind), "confidence": confidence if isinstance(confidence, Column) else F.lit(confidence)} | columns
    kinds = {"variables": "array<string>", "lo": "double", "hi": "double", "confidence": "double"}
    return [given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]


def _names(text: Column, pattern: str, but: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: v != but))


def prose_variables(docs: DataFrame) -> DataFrame:
    """``let X be ...`` and ``where X denotes|represents|is ...``."""
    parts = [_matches(docs, p, 2).select(*_fact("variable", 0.7, symbol=F.col("g1"), description=_strip("g2"))) for p in VARIABLES]
    return parts[0].unionByName(parts[1])


def prose_boundaries(docs: DataFrame) -> DataFrame:
    """``X must be between a and b``, and one-sided bounds; "at least" is strict, as are above and over."""
    fact = lambda e: _fact("boundary", 0.7, symbol=F.col("g1"), description=_strip("g0"), expression=e, variables=F.array("g1"))
    out = _matches(docs, BETWEEN, 3).select(*fact(F.concat_ws(" <= ", "g2", "g1", "g3")))
    for sign, pattern in BOUNDS:
        out = out.unionByName(_matches(docs, pattern, 2).select(*fact(F.concat_ws(f" {sign} ", "g1", "g2"))))
    return out


def prose_equations(docs: DataFrame) -> DataFrame:
    """``lhs = rhs`` up to the sentence's end; a comparison ``x == 1`` counts, with rhs ``= 1``."""
    rows = _matches(docs, EQUATION, 2).withColumn("rhs", _strip("g2")).where("rhs <> ''")
    return rows.select(*_fact("equation", 0.6, symbol=F.col("g1"), expression=F.concat_ws(" = ", "g1", "rhs"), variables=_names(F.col("rhs"), IDENT, F.col("g1"))))


def prose_facts(docs: DataFrame) -> DataFrame:
    """Facts of prose documents (doc, text)."""
    return prose_variables(docs).unionByName(prose_boundaries(docs)).unionByName(prose_equations(docs))


def c_facts(docs: DataFrame) -> DataFrame:
    """Macros, constants and assertions of C-like code (doc, text)."""
    named = _matches(docs, DEFINE, 2).unionByName(_matches(docs, CONSTANT, 2)).withColumn("value", _strip("g2"))
    is_text, is_number = F.col("value").rlike(C_STRING), F.col("value").rlike(C_NUMBER)
    about = F.concat(F.lit("constant '"), F.col("g1"), F.lit("'"))
    number = F.regexp_replace("value", "[fFlL]+$", "").try_cast("double")
    texts = named.where(is_text).select(*_fact("variable", 0.85, symbol=F.col("g1"), description=about, type_hint=F.lit("string")))
    hint = F.when(F.contains("value", F.lit(".")), "real").otherwise("integer")
    numbers = named.where(~is_text & is_number).select(*_fact("variable", 0.85, symbol=F.col("g1"), description=about, lo=number, hi=number, type_hint=hint))
    rest = named.where(~is_text & ~is_number).select(*_fact("equation", 0.7, symbol=F.col("g1"), expression=F.concat_ws(" = ", "g1", "value"), variables=_names(F.col("value"), C_IDENT, F.col("g1"))))
    asserted = _matches(docs, ASSERTION, 1).withColumn("names", F.regexp_extract_all("g1", F.lit(C_IDENT), F.lit(0)))
    boundaries = asserted.select(*_fact("boundary", 0.85, symbol=F.coalesce(F.get("names", F.lit(0)), F.lit("assert")), description=F.concat(F.lit("assert("), F.col("g1"), F.lit(")")), expression=F.col("g1"), variables=F.col("names")))
    return texts.unionByName(numbers).unionByName(rest).unionByName(boundaries)


_ENTRY = "array<struct<symbol:string,name:string,description:string,type_hint:string,type:string,bounds:array<double>,confidence:double,expression:string,variables:array<string>,lhs:string,rhs:string>>"
_SHAPE = ", ".join(f"{k} {_ENTRY}" for k in ("state_variables", "variables", "boundaries", "constraints", "equations"))


def json_structured(docs: DataFrame) -> DataFrame:
    """Facts of JSON objects that list them; entries without their required keys are left out."""
    rows = docs.withColumn("j", F.from_json("text", _SHAPE)).where(F.coalesce("j.state_variables", "j.variables", "j.boundaries", "j.constraints", "j.equations").isNotNull())
    entries = lambda *names: rows.select("doc", F.explode(F.coalesce(*[f"j.{n}" for n in names])).alias("e")).select("doc", "e.*")
    name, sure = F.coalesce("symbol", "name"), F.coalesce("confidence", F.lit(0.95))
    pair = lambda k: F.when(F.size("bounds") == 2, F.get("bounds", F.lit(k)))
    none = F.array().cast("array<string>")
    about = F.coalesce("description", F.lit(""))
    variables = entries("state_variables", "variables").where(name.isNotNull()).select(*_fact("variable", sure, symbol=name, description=about, type_hint=F.coalesce("type_hint", "type", F.lit("unknown")), lo=pair(0), hi=pair(1)))
    bounds = entries("boundaries", "constraints").where("expression is not null").select(*_fact("boundary", sure, symbol=F.coalesce("symbol", "name", F.lit("boundary")), description=F.coalesce("description", "expression"), expression=F.col("expression"), variables=F.coalesce("variables", none)))
    equal = entries("equations").where("lhs is not null and rhs is not null").select(*_fact("equation", sure, symbol=F.coalesce("symbol", "lhs"), expression=F.coalesce("expression", F.concat_ws(" = ", "lhs", "rhs")), variables=F.coalesce("variables", none)))
    return variables.unionByName(bounds).unionByName(equal)


def json_scalars(docs: DataFrame) -> DataFrame:
    """Top-level scalars of JSON objects that list no facts; numbers are bounds of themselves."""
    keys = ["state_variables", "variables", "boundaries", "constraints", "equations"]
    value = F.try_parse_json("text")
    rows = docs.withColumn("v", value).where("v is not null").where(F.schema_of_variant("v").startswith("OBJECT"))
    flat = rows.select("doc", F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("m"))
    flat = flat.where(~F.arrays_overlap(F.map_keys("m"), F.array(*map(F.lit, keys)))).select("doc", F.explode("m").alias("key", "value"))
    kind = F.schema_of_variant("value")
    hint = F.when(kind == "BOOLEAN", "boolean").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "real").when(kind == "STRING", "string")
    number = F.when(hint.isin("integer", "real"), F.expr("try_variant_get(value, '$', 'double')"))
    about = F.concat(F.lit("configuration value '"), F.col("key"), F.lit("'"))
    return flat.where(hint.isNotNull()).select(*_fact("variable", 0.5, symbol=F.col("key"), description=about, lo=number, hi=number, type_hint=hint))


def json_facts(docs: DataFrame) -> DataFrame:
    return json_structured(docs).unionByName(json_scalars(docs))


def match_lines(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc, pattern, nth, line, start) of every match; needs offsets, hence Arrow batches of Python."""
    compiled = {k: re.compile(p) for k, p in patterns.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                for name, pattern in compiled.items():
                    for n, m in enumerate(pattern.finditer(text or "")):
                        rows.append((doc, name, n, text.count("\n", 0, m.start()) + 1, m.start()))
            yield pd.DataFrame(rows, columns=["doc", "pattern", "nth", "line", "start"])

    return docs.select(F.col("doc").cast("string").alias("doc"), "text").mapInPandas(run, "doc string, pattern string, nth long, line long, start long")


def disambiguated(facts: DataFrame) -> DataFrame:
    """Repeated (kind, domain, symbol) become ``x``, ``x#2``, ``x#3`` by ``seq``."""
    nth = F.row_number().over(Window.partitionBy("kind", "domain", "symbol").orderBy("seq"))
    unique = F.when(nth == 1, F.col("symbol")).otherwise(F.concat_ws("#", "symbol", nth))
    return facts.withColumn("unique_symbol", unique).withColumn("fact_id", F.concat_ws("::", "domain", "unique_symbol"))


def reference_edges(facts: DataFrame) -> DataFrame:
    """(src, dst): from a boundary or equation to the variables of its domain that it names.

    A later variable of a symbol takes the place of an earlier one; a fact names not itself.
    """
    known = facts.where("kind = 'variable'").groupBy("domain", "symbol").agg(F.max_by("fact_id", "seq").alias("dst"))
    used = facts.where("kind <> 'variable'").select("domain", F.col("fact_id").alias("src"), F.explode("variables").alias("symbol"))
    return used.join(known, ["domain", "symbol"]).where("src <> dst").select("src", "dst", F.lit("references").alias("edge_type")).distinct()


def shared_symbols(facts: DataFrame) -> DataFrame:
    """(src, dst, symbol) between variables of one name in different domains, both ways."""
    own = facts.where("kind = 'variable'").select("domain", "unique_symbol", "fact_id").distinct()
    other = own.select(F.col("domain").alias("domain2"), "unique_symbol", F.col("fact_id").alias("dst"))
    return own.join(other, "unique_symbol").where("domain <> domain2").select(F.col("fact_id").alias("src"), "dst", F.col("unique_symbol").alias("symbol"), F.lit("shared_symbol").alias("edge_type"))


def linked_domains(facts: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of explicit links (domain_a, symbol_a, domain_b, symbol_b, relation); an end that is no fact is an error."""
    known = facts.select("fact_id").distinct()
    ends = links.select(F.concat_ws("::", "domain_a", "symbol_a").alias("src"), F.concat_ws("::", "domain_b", "symbol_b").alias("dst"), F.coalesce("relation", F.lit("maps_to")).alias("edge_type"))
    both = ends.join(known.select(F.col("fact_id").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(known.select(F.col("fact_id").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    missing = F.when(F.col("has_src").isNull(), F.col("src")).when(F.col("has_dst").isNull(), F.col("dst"))
    checked = F.when(missing.isNotNull(), F.raise_error(F.concat(F.lit("no fact "), missing)).cast("string")).otherwise(F.col("edge_type"))
    return both.select("src", "dst", checked.alias("edge_type"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by type, edges by type, domains and edges that cross them."""
    by_node = nodes.groupBy(F.concat(F.lit("node:"), F.col("kind")).alias("what")).agg(F.count("*").alias("n"))
    by_edge = edges.groupBy(F.concat(F.lit("edge:"), F.col("edge_type")).alias("what")).agg(F.count("*").alias("n"))
    domains = nodes.agg(F.countDistinct("domain").alias("n")).select(F.lit("domains").alias("what"), "n")
    return by_node.unionByName(by_edge).unionByName(domains)


def violations(facts: DataFrame) -> DataFrame:
    """Facts that lack what their kind requires."""
    missing = F.filter(
        F.array(F.when(F.coalesce("symbol", F.lit("")) == "", "symbol"), F.when(F.coalesce("domain", F.lit("")) == "", "domain"), F.when((F.col("kind") != "variable") & (F.coalesce("expression", F.lit("")) == ""), "expression")),
        lambda x: x.isNotNull(),
    )
    return facts.withColumn("missing", F.array_join(missing, ",")).where("missing <> ''")
