"""Vocabularies and small formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of two schedulers; the first map wins.
JOB_STATES = {
    "R": "RUNNING", "RUNNING": "RUNNING", "PD": "PENDING", "PENDING": "PENDING", "CF": "PENDING", "CG": "RUNNING",
    "COMPLETING": "RUNNING", "CD": "COMPLETED", "COMPLETED": "COMPLETED", "F": "FAILED", "FAILED": "FAILED",
    "CA": "CANCELLED", "CANCELLED": "CANCELLED", "TO": "TIMEOUT", "TIMEOUT": "TIMEOUT", "NF": "NODE_FAIL",
}
QUEUE_STATES = {"Q": "PENDING", "H": "PENDING", "W": "PENDING", "T": "PENDING", "E": "RUNNING", "B": "RUNNING", "C": "COMPLETED"}

# Hints in a target's name, in order; ways to call a core from a binding.
NAME_HINTS = [
    ("cpp", ["cpp", "cxx", "cplus", "cc"]),
    ("rust", ["rust", "_rs", "rs_", "cargo"]),
    ("python", ["python", "py_", "_py", "dashboard", "ui", "web", "flask", "django", "panel", "notebook"]),
    ("fortran", ["fortran", "f90"]),
    ("c", ["c_core", "clang", "_c_"]),
]
COMPILED = ["cpp", "c", "rust", "fortran"]
# Languages of an extension, the order in which ties are decided, and words that name languages only.
LANGUAGES_OF_EXTENSION = {
    ".cpp": ["cpp"], ".cc": ["cpp"], ".cxx": ["cpp"], ".hpp": ["cpp"], ".hh": ["cpp"], ".h": ["cpp", "c"], ".c": ["c"], ".rs": ["rust"],
    ".py": ["python"], ".pyi": ["python"], ".f90": ["fortran"], ".f": ["fortran"], ".f95": ["fortran"],
}
EXTENSION_ORDER = ["cpp", "c", "rust", "python", "fortran"]
LANGUAGE_WORDS = ["cpp", "rust", "python", "py", "c", "fortran"]
MECHANISMS = {"cpp": "pybind11", "c": "ctypes", "rust": "pyo3", "fortran": "ctypes"}

# Names of files that are not hot, and the density from which others are.
COLD_NAMES = r"(?i)(config|settings|\.env|constants|setup\.py|setup\.cfg|package\.json|tsconfig|\.eslintrc|webpack|Cargo\.toml|Cargo\.lock|build\.rs)|(template|component|\.html|\.css|\.scss|render\s*\()"
HOT_DENSITY = 5.0

# Kinds of syntax nodes by language, and rules on node types.
CANONICAL = {
    "python": {"function_definition": "function_declaration", "class_definition": "type_declaration", "import_statement": "import_declaration", "import_from_statement": "import_declaration", "module": "translation_unit"},
    "rust": {"function_item": "function_declaration", "struct_item": "type_declaration", "enum_item": "type_declaration", "union_item": "type_declaration", "trait_item": "type_declaration", "type_item": "type_declaration", "use_declaration": "import_declaration", "mod_item": "module_declaration", "source_file": "translation_unit"},
    "cpp": {"function_definition": "function_declaration", "class_specifier": "type_declaration", "struct_specifier": "type_declaration", "namespace_definition": "module_declaration", "preproc_include": "import_declaration", "translation_unit": "translation_unit"},
    "c": {"function_definition": "function_declaration", "struct_specifier": "type_declaration", "union_specifier": "type_declaration", "preproc_include": "import_declaration", "translation_unit": "translation_unit"},
}
COMMENT_TYPES = ["comment", "line_comment", "block_comment", "doc_comment"]
SUFFIX_RULES = [("DECLARATION", ["_definition", "_declaration", "_item", "_specifier", "_declarator"]), ("STATEMENT", ["_statement"]), ("EXPRESSION", ["_expression", "_expr"])]
TYPE_NAMES = ["type_identifier", "primitive_type", "type"]
LITERAL_HINTS = ["literal", "number", "string", "char", "integer", "float", "boolean", "true", "false"]

# Signs that a computation needs more precision.
TRANSCENDENTAL = ["exp", "log", "log10", "log2", "pow", "sqrt", "sin", "cos", "tan", "sinh", "cosh", "tanh", "expm1", "erf", "gamma"]
ITERATIVE = ["solve", "solver", "iterate", "newton", "gmres", "bicg", "conjugate_gradient", "_cg", "jacobi", "gauss_seidel", "relax", "converge", "fixed_point", "krylov"]
CONDITIONING = ["inverse", "inv(", "matmul", "matrix_mul", "determinant", "det(", "eig", "eigen", "lu_decomp", "cholesky", "svd", "condition_number", "linsolve"]

#: The largest inverse of a time.
INVERSE_CAP = 1e9


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def job_state(raw: Column) -> Column:
    code = F.upper(F.trim(raw))
    known = F.create_map(*[F.lit(x) for k, v in (QUEUE_STATES | JOB_STATES).items() for x in (k, v)])
    return F.coalesce(F.try_element_at(known, code), F.when(code != "", code), F.lit("UNKNOWN"))


def language_of_name(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(any_of(low, hints), F.lit(lang)) for lang, hints in NAME_HINTS], F.lit("unknown"))


def path_class(path: Column, density: Column) -> Column:
    return F.when(~path.rlike(COLD_NAMES) & (density >= HOT_DENSITY), "hot").otherwise("cold")


def canonical_kind(language: Column, node_type: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for lang, kinds in CANONICAL.items() for t, k in kinds.items() for x in (f"{lang}/{t}", k)])
    return F.try_element_at(pairs, F.concat_ws("/", language, node_type))


def node_category(language: Column, node_type: Column, named: Column, error: Column) -> Column:
    """Category of a syntax node; the first rule that holds decides."""
    kind, low = canonical_kind(language, node_type), F.lower(node_type)
    ends = lambda suffixes: F.greatest(*[low.endswith(s) for s in suffixes], F.lit(False))
    out = F.when(error | (node_type == "ERROR"), "ERROR").when(node_type.isin(COMMENT_TYPES), "COMMENT")
    out = out.when(kind.endswith("_declaration"), "DECLARATION").when(kind.endswith("translation_unit"), "MODULE")
    out = out.when(~named & node_type.rlike("^[A-Za-z]+$"), "KEYWORD").when(~named, "PUNCTUATION")
    for category, suffixes in SUFFIX_RULES:
        out = out.when(ends(suffixes), category)
    return out.when(low.isin(TYPE_NAMES), "TYPE").when(F.contains(low, F.lit("identifier")), "IDENTIFIER").when(any_of(low, LITERAL_HINTS), "LITERAL").otherwise("UNKNOWN")


def precision_reason(is_call: Column, name: Column, text: Column) -> Column:
    low, whole = F.lower(name), F.lower(text)
    hint = lambda words: any_of(low, words) | any_of(whole, words)
    return (
        F.when(is_call & low.isin(TRANSCENDENTAL), F.concat(F.lit("transcendental call '"), low, F.lit("' accumulates rounding error")))
        .when(hint(ITERATIVE), "iterative solver pattern is sensitive to precision")
        .when(hint(CONDITIONING), "linear-algebra op may be ill-conditioned")
    )


def inverse_seconds(seconds: Column) -> Column:
    """1/s up to a cap: the cap at 0, and 0 for null, negative, infinite or NaN."""
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    return F.when(bad, 0.0).when(seconds == 0, INVERSE_CAP).otherwise(F.least(F.lit(INVERSE_CAP), F.try_divide(F.lit(1.0), seconds)))


def objective(value: Column) -> Column:
    """A measurement as objective: null, NaN and negative are 0, infinite is the cap."""
    return F.when(value.isNull() | F.isnan(value) | (value < 0), 0.0).otherwise(F.least(value, F.lit(INVERSE_CAP)))


def net_benefit(score: Column, cost: Column, step: Column, transitions: Column, gamma: float = 0.97, penalty: float = 0.02) -> Column:
    return score * F.pow(F.lit(gamma), step) - (cost + F.lit(penalty) * transitions)


def warmup(cycle: Column, first: float, least: float, cycles: int) -> Column:
    return F.lit(least) + F.lit(first - least) * (cycle / F.lit(float(max(cycles, 1))))


def exponential_rate(cycle: Column, first: float = 0.01, least: float = 1e-5, cycles: int = 50, decay: float = 0.995) -> Column:
    return F.when(cycle < cycles, warmup(cycle, first, least, cycles)).otherwise(F.greatest(F.lit(least), F.lit(first) * F.pow(F.lit(decay), cycle - cycles)))


def step_rate(cycle: Column, first: float = 0.01, least: float = 1e-5, cycles: int = 50, drop: float = 0.5, every: int = 100) -> Column:
    return F.when(cycle < cycles, warmup(cycle, first, least, cycles)).otherwise(F.greatest(F.lit(least), F.lit(first) * F.pow(F.lit(drop), F.floor((cycle - cycles) / F.lit(every)))))


def cosine_rate(cycle: Column, first: float = 0.01, least: float = 1e-5, cycles: int = 50, period: int = 100, grows: float = 2.0) -> Column:
    """Cosine annealing with restarts; the k-th period has period * grows ** k cycles.

    With a growth of 2 the restart follows from a logarithm; the sums of the periods before
    are period * (2 ** k - 1).
    """
    if grows != 2.0:
        raise ValueError("only doubling periods have a closed form here")
    at = (cycle - cycles).cast("double")
    k = F.floor(F.log2(F.greatest(at, F.lit(0.0)) / period + 1) + 1e-12)
    length = F.lit(float(period)) * F.pow(F.lit(2.0), k)
    inside = at - F.lit(float(period)) * (F.pow(F.lit(2.0), k) - 1)
    rate = F.lit(least) + F.lit(first - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * inside / length))
    return F.when(cycle < cycles, warmup(cycle, first, least, cycles)).otherwise(F.greatest(F.lit(least), rate))
