"""Text functions as Column expressions: nothing here leaves the JVM or shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts tokens.
TOKEN = r"[^ \t\n\x0B\f\r]+"

# Words of each domain, in the order in which ties are decided.
DOMAIN_KEYWORDS = {
    "genomics": ["dna", "rna", "genome", "gene", "allele", "codon", "nucleotide", "chromosome", "mutation", "transcription", "genotype", "phenotype", "exon", "intron", "genomic"],
    "medicine": ["patient", "diagnosis", "dosage", "dose", "clinical", "symptom", "treatment", "therapy", "mg/kg", "contraindicated", "prescribed", "physician", "comorbidity"],
    "economics": ["gdp", "inflation", "equilibrium", "elasticity", "market", "supply", "demand", "interest rate", "utility", "macroeconomic", "fiscal", "monetary", "tariff", "recession"],
    "physics": ["velocity", "acceleration", "force", "energy", "momentum", "mass", "newton", "joule", "thermodynamic", "quantum", "relativity", "torque"],
    "game_engine": ["frame", "render", "shader", "entity", "sprite", "collider", "viewport", "raycast", "physics tick", "game loop", "actor", "skeletal", "tilemap"],
    "mathematics": ["theorem", "integral", "derivative", "matrix", "vector", "polynomial", "proof", "lemma", "axiom", "eigenvalue", "differential"],
}
DEFAULT_DOMAIN = "general"

# Patterns of the token profile (multi-line).
TOKEN_PATTERNS = {
    "function_def": r"\bdef\s+[a-zA-Z_]\w*\s*\(",
    "class_def": r"\bclass\s+[a-zA-Z_]\w*\s*[\(:]",
    "import_stmt": r"^\s*(?:from\s+\S+\s+)?import\s+",
    "decorator": r"^\s*@[a-zA-Z_]\w*",
    "string_literal": r"(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*')",
    "numeric_literal": r"\b(?:0[xXoObB])?[\d]+(?:\.[\d]+)?(?:[eE][+-]?\d+)?\b",
    "comment_line": r"#[^\n]*",
    "assignment": r"[a-zA-Z_]\w*\s*(?:[:+\-*/|&^]=|=(?!=))",
    "return_stmt": r"\breturn\b",
    "raise_stmt": r"\braise\b",
    "try_block": r"\btry\s*:",
    "except_block": r"\bexcept\b",
    "with_stmt": r"\bwith\b",
    "yield_expr": r"\byield\b",
    "lambda_expr": r"\blambda\b",
    "list_comp": r"\[.+\bfor\b.+\bin\b.+\]",
    "dict_comp": r"\{.+:\s*.+\bfor\b.+\bin\b.+\}",
    "assert_stmt": r"\bassert\b",
    "global_stmt": r"\bglobal\b",
    "nonlocal_stmt": r"\bnonlocal\b",
    "async_def": r"\basync\s+def\b",
    "await_expr": r"\bawait\b",
}


def tokens(text: Column) -> Column:
    """White-space tokens; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.coalesce(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.array().cast("array<string>"))


def entropy(items: Column) -> Column:
    """Shannon bits of an array's values; 0 for an empty one.

    The values are sorted and folded run by run, so a document needs no shuffle:
    log2(n) - sum(c log2 c) / n over the runs' lengths c.
    """
    n = F.size(items)
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))
    weight = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def step(acc: Column, x: Column) -> Column:
        same = acc["value"].eqNullSafe(x)
        return F.struct(x.alias("value"), F.when(same, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + weight(acc["run"])).alias("sum"))

    total = F.aggregate(F.array_sort(items), start, step, lambda a: a["sum"] + weight(a["run"]))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n.cast("double")) - total / n)).otherwise(F.lit(0.0))


def keyword_count(text: Column, word: str) -> Column:
    """Occurrences of a word that don't overlap, inside other words too; most texts don't hold it at all."""
    return F.when(F.contains(text, F.lit(word)), ((F.length(text) - F.length(F.replace(text, F.lit(word)))) / len(word)).cast("long")).otherwise(F.lit(0).cast("long"))


def with_domains(docs: DataFrame, stem: Column, text: Column, form: Column) -> DataFrame:
    """``docs`` with a column for each domain, its words' occurrences, and ``domain``: one projection each, no explode.

    The lowered text is a column of its own, so that it is made once for all words.
    """
    name = "_lowered" + "_" * sum(c.startswith("_lowered") for c in docs.columns)
    whole = docs.withColumn(name, F.lower(F.concat_ws(" ", stem, text)))
    scores = {domain: sum((keyword_count(F.col(name), w) for w in words), F.lit(0)).cast("long") for domain, words in DOMAIN_KEYWORDS.items()}
    return whole.withColumns(scores).drop(name).withColumn("domain", best_domain(form))


def best_domain(form: Column) -> Column:
    """Code documents are of their format, others of the first domain with the highest score above 0."""
    ranked = F.array(*[F.struct(F.col(n).alias("score"), F.lit(-k).alias("rank"), F.lit(n).alias("name")) for k, n in enumerate(DOMAIN_KEYWORDS)])
    chosen = F.get(F.transform(F.array(F.array_max(ranked)), lambda x: F.when(x["score"] > 0, x["name"]).otherwise(DEFAULT_DOMAIN)), F.lit(0))
    return F.when(form.startswith("code:"), form).otherwise(chosen)


def token_profile(text: Column) -> list[Column]:
    return [F.coalesce(F.regexp_count(text, F.lit("(?m)" + p)), F.lit(0)).cast("long").alias(n) for n, p in TOKEN_PATTERNS.items()]


def fingerprint(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def semantic_fingerprint(text: Column) -> Column:
    """32 hex digits of what is left without comments and with white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"#[^\n]*", ""), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.substring(F.sha2(F.trim(F.regexp_replace(bare, r"\s+", " ")).cast("binary"), 256), 1, 32)


def parameter_fingerprint(text: Column) -> Column:
    """16 hex digits of a text's quoted strings and whole numbers, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"\"[^\"]*\"|\b\d+\b"), F.lit(0))
    return F.substring(F.sha2(F.array_join(F.array_sort(found), "|").cast("binary"), 256), 1, 16)


def structural_diversity(text: Column) -> Column:
    """Distinct task bodies over all; 1 without any. Heads and needs lines are no part of a body."""
    own = lambda block: F.filter(lines(block), lambda x: ~x.startswith("[task:") & ~x.startswith("needs ="))
    bodies = F.filter(F.transform(F.split(text, r"(?=\[task:)"), lambda x: F.array_join(own(x), "\n")), lambda x: x != "")
    return F.when(F.size(bodies) > 0, F.size(F.array_distinct(bodies)) / F.size(bodies)).otherwise(F.lit(1.0))


def namespaced(domain: Column, symbol: Column) -> Column:
    return F.concat_ws("::", domain, symbol)


def ngrams(items: Column, n: int) -> Column:
    """All runs of n values, each joined by a blank."""
    count = F.size(items) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.array_join(F.slice(items, k, n), " "))).otherwise(F.array().cast("array<string>"))
