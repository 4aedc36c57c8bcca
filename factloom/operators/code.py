"""Facts and scores of Python source, file by file in Arrow batches (one file is one row's work)."""

from __future__ import annotations

import ast
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERNS


def per_file(files: DataFrame, extract: Callable[[str, str], list[tuple]], columns: list[tuple[str, str]]) -> DataFrame:
    """Rows that ``extract`` makes of each (path, text); files that don't parse give none."""
    names = [c for c, _ in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += extract(path, text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(run, ", ".join(f"{c} {t}" for c, t in columns))


# Type names of constants, and calls that count as work on sequences and texts.
_HINTS = {bool: "boolean", int: "integer", float: "real", str: "string"}
HOT_CALLS = frozenset(
    "append extend insert pop remove sort reverse split join replace find index count strip startswith endswith encode decode format map filter reduce sorted zip enumerate".split()
)


def _named_constant(node: ast.stmt) -> tuple[str, object] | None:
    """The name and value of ``name = constant`` or ``name: type = constant``; None is no constant."""
    target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else node.target if isinstance(node, ast.AnnAssign) else None
    if isinstance(target, ast.Name) and isinstance(node.value, ast.Constant) and node.value.value is not None:
        return target.id, node.value.value
    return None


def _used(node: ast.AST) -> list[str]:
    return [n.id for n in ast.walk(node) if isinstance(n, ast.Name)]


def _facts(path: str, text: str) -> list[tuple]:
    tree, out = ast.parse(text), []
    for node in tree.body:
        named = _named_constant(node)
        if named:
            name, v = named
            number = float(v) if type(v) in (int, float) else None
            out.append((path, "variable", name, _HINTS.get(type(v), "unknown"), None, [], number, node.lineno, 0.9))
    for node in ast.walk(tree):
        if isinstance(node, ast.Assert) and isinstance(node.test, ast.Compare):
            names = _used(node.test)
            out.append((path, "boundary", names[0] if names else f"assert_{node.lineno}", None, ast.unparse(node.test), names, None, node.lineno, 0.9))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            # Docstrings and other bare constants aside, the body is one return of more than a name or constant.
            rest = [x for x in node.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))]
            value = rest[0].value if len(rest) == 1 and isinstance(rest[0], ast.Return) else None
            if value is not None and not isinstance(value, (ast.Constant, ast.Name)):
                out.append((path, "equation", node.name, None, f"{node.name} = {ast.unparse(value)}", list(dict.fromkeys(_used(value))), None, node.lineno, 0.8))
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """Constants of modules, asserted comparisons and functions of one returned expression."""
    columns = [("path", "string"), ("kind", "string"), ("symbol", "string"), ("type_hint", "string"), ("expression", "string"), ("variables", "array<string>"), ("value", "double"), ("line", "long"), ("confidence", "double")]
    return per_file(files, _facts, columns)


_LOOPS = (ast.For, ast.While, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _depth(node: ast.AST, now: int = 0) -> int:
    """Deepest nesting of loops and comprehensions; ``async for`` is none."""
    here = now + isinstance(node, _LOOPS)
    return max([here, *(_depth(c, here) for c in ast.iter_child_nodes(node))])


def _called(node: ast.AST) -> list[str]:
    """Names of calls, by name or by attribute."""
    found = (n.func for n in ast.walk(node) if isinstance(n, ast.Call))
    return [f.id if isinstance(f, ast.Name) else f.attr for f in found if isinstance(f, (ast.Name, ast.Attribute))]


def _functions(path: str, text: str) -> list[tuple]:
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            calls, depth = _called(node), _depth(node)
            ops, again = sum(c in HOT_CALLS for c in calls), node.name in calls
            span = max((node.end_lineno or node.lineno) - node.lineno + 1, 1)
            out.append((path, node.name, depth, ops, again, len(calls), span, round(depth * 3.0 + ops * 1.5 + 5.0 * again + len(calls) * 0.2 + span * 0.05, 2)))
    return out


SCORED = [("path", "string"), ("function", "string"), ("depth", "long"), ("ops", "long"), ("recursive", "boolean"), ("calls", "long"), ("span", "long"), ("score", "double")]


def function_scores(files: DataFrame) -> DataFrame:
    """Depth of loops, sequence work, recursion, calls, length and their weighted sum for each Python function."""
    return per_file(files, _functions, SCORED)


def file_density(scores: DataFrame) -> DataFrame:
    """(path, functions, density, hottest): a file's best and summed score."""
    return scores.groupBy("path").agg(F.count("*").alias("functions"), F.round(F.sum("score"), 2).alias("total"), F.max("score").alias("hottest"))


def _names(path: str, text: str) -> list[tuple]:
    out = set()
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Name):
            out.add((path, node.id, "used" if isinstance(node.ctx, ast.Load) else "defined"))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.add((path, node.name, "defined"))
            if not isinstance(node, ast.ClassDef):
                out |= {(path, a.arg, "defined") for a in [*node.args.args, *node.args.kwonlyargs, *node.args.posonlyargs]}
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            out |= {(path, (a.asname or a.name).split(".")[0], "imported") for a in node.names}
    return sorted(out)


def name_roles(files: DataFrame) -> DataFrame:
    """(path, name, role) of names that a file uses, defines or imports."""
    return per_file(files, _names, [("path", "string"), ("name", "string"), ("role", "string")])


def undefined_names(roles: DataFrame, builtins: list[str] | None = None) -> DataFrame:
    """(path, name): used, but neither defined, imported nor built in."""
    import builtins as b

    known = roles.where("role <> 'used'").select("path", "name").distinct()
    return roles.where("role = 'used'").select("path", "name").join(known, ["path", "name"], "left_anti").where(~F.col("name").isin(builtins or dir(b)))


def unused_imports(roles: DataFrame) -> DataFrame:
    used = roles.where("role = 'used'").select("path", "name")
    return roles.where("role = 'imported'").select("path", "name").join(used, ["path", "name"], "left_anti")


def missing_imports(roles: DataFrame, utilities: DataFrame | None = None) -> DataFrame:
    """(path, name, provider): undefined names that another file defines.

    The provider is that of ``utilities`` (name, provider) if it has the name, else the first file by
    path; each name has one before names meet, so a name that many files define or use costs no pairs.
    """
    first = roles.where("role = 'defined'").groupBy("name").agg(F.min("path").alias("provider"))
    if utilities is not None:
        own = utilities.groupBy("name").agg(F.min("provider").alias("own"))
        first = first.join(own, "name", "full_outer").select("name", F.coalesce("own", "provider").alias("provider"))
    both = undefined_names(roles).distinct()
    return both.join(first, "name").where("path <> provider").select("path", "name", "provider")


def _nodes(path: str, text: str) -> list[tuple]:
    out: list[tuple] = []

    def walk(node: ast.AST, parent: int | None, depth: int) -> None:
        k = len(out)
        out.append((path, k, parent, type(node).__name__, depth))
        for c in ast.iter_child_nodes(node):
            walk(c, k, depth + 1)

    walk(ast.parse(text), None, 0)
    return out


def syntax_nodes(files: DataFrame) -> DataFrame:
    """(path, id, parent, type, depth) in order of a walk."""
    return per_file(files, _nodes, [("path", "string"), ("id", "long"), ("parent", "long"), ("type", "string"), ("depth", "long")])


def _ast_entropy(path: str, text: str) -> list[tuple]:
    counts = Counter(type(n).__name__ for n in ast.walk(ast.parse(text)))
    n = sum(counts.values())
    return [(path, n, round(-sum(c / n * math.log2(c / n) for c in counts.values()), 6))]


def syntax_entropy(files: DataFrame) -> DataFrame:
    return per_file(files, _ast_entropy, [("path", "string"), ("nodes", "long"), ("entropy", "double")])


_PATTERNS = {k: re.compile(p, re.MULTILINE) for k, p in TOKEN_PATTERNS.items()}


def _sequence(path: str, text: str) -> list[tuple]:
    found = [(m.start(), k) for k, p in _PATTERNS.items() for m in p.finditer(text)]
    return [(path, n, start, kind) for n, (start, kind) in enumerate(sorted(found, key=lambda x: x[0]))]


def token_sequence(files: DataFrame) -> DataFrame:
    """(path, n, start, token): token categories in the order of their starts."""
    return per_file(files, _sequence, [("path", "string"), ("n", "long"), ("start", "long"), ("token", "string")])


_LEX = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|\"[^\"\n]*\"|'[^'\n]*'|[^\s\w]")


def _lexical(path: str, text: str) -> list[tuple]:
    out, depth = [], 0
    for n, m in enumerate(_LEX.finditer(text)):
        t = m.group()
        depth -= t in ")]}"
        kind = "identifier" if re.match(r"[A-Za-z_]", t) else "number" if t[0].isdigit() else "string" if t[0] in "\"'" else "punctuation"
        out.append((path, n, kind, t, max(depth, 0)))
        depth += t in "([{"
    return out


def lexical_tokens(files: DataFrame) -> DataFrame:
    """(path, n, kind, text, depth): tokens with their depth of brackets, for any language."""
    return per_file(files, _lexical, [("path", "string"), ("n", "long"), ("kind", "string"), ("text", "string"), ("depth", "long")])


def _symbols(path: str, text: str) -> list[tuple]:
    tree = list(ast.walk(ast.parse(text)))
    functions = sorted({n.name for n in tree if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))})
    return [(path, functions, sorted({n.name for n in tree if isinstance(n, ast.ClassDef)}))]


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, functions, types) of Python files, each sorted and distinct."""
    return per_file(files, _symbols, [("path", "string"), ("functions", "array<string>"), ("types", "array<string>")])


_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_DEFINED = re.compile(r"\b([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:const\s*)?\{")
_TYPED = re.compile(r"\b(?:struct|class|enum|union)\s+([A-Za-z_]\w*)")
_NO_FUNCTIONS = {"if", "for", "while", "switch", "catch"}


def _outline(path: str, text: str) -> list[tuple]:
    plain = _COMMENT.sub(" ", text)
    kinds = [t if kind == "punctuation" else kind for _, _, kind, t, _ in _lexical(path, plain)]
    functions = sorted({m for m in _DEFINED.findall(plain) if m not in _NO_FUNCTIONS})
    return [(path, hashlib.sha256("\n".join(kinds).encode()).hexdigest(), functions, sorted(set(_TYPED.findall(plain))))]


def outlines(files: DataFrame) -> DataFrame:
    """(path, semantic_hash, functions, types) of files in languages with braces and without a parser here.

    The hash is of the kinds of tokens and the signs, so names, white space and comments make no difference.
    """
    return per_file(files, _outline, [("path", "string"), ("semantic_hash", "string"), ("functions", "array<string>"), ("types", "array<string>")])


# Types of nodes that hold a declaration's name.
NAME_TYPES = ("identifier", "type_identifier", "name", "field_identifier")


def declared_symbols(nodes: DataFrame) -> DataFrame:
    """(file, functions, types) of syntax nodes (file, id, parent, type, kind, text).

    A declaration's name is the first name below it, level by level. A file's nodes are one
    task's work, as a file is one row's elsewhere.
    """

    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict[int, list[int]] = {}
        for child, parent in zip(pdf["id"], pdf["parent"], strict=True):
            if not pd.isna(parent):
                below.setdefault(int(parent), []).append(int(child))
        kind, text = dict(zip(pdf["id"], pdf["type"], strict=True)), dict(zip(pdf["id"], pdf["text"], strict=True))

        def name(of: int) -> str | None:
            level = sorted(below.get(of, []))
            while level:
                found = next((n for n in level if kind[n] in NAME_TYPES), None)
                if found is not None:
                    return text[found]
                level = [c for n in level for c in sorted(below.get(n, []))]
            return None

        symbols = {k: sorted({name(int(i)) for i in pdf.loc[pdf["kind"] == k, "id"]} - {None}) for k in ("function_declaration", "type_declaration")}
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "functions": [symbols["function_declaration"]], "types": [symbols["type_declaration"]]})

    rows = nodes.select(F.col("file").cast("string").alias("file"), "id", "parent", "type", "kind", "text")
    return rows.groupBy("file").applyInPandas(named, "file string, functions array<string>, types array<string>")


def syntax_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes (id, language, kind) by language and by kind, edges (src, dst, edge_type) by type, and both in all."""
    count = lambda df, what, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    out = count(nodes, "language", F.coalesce("language", F.lit("unknown"))).unionByName(count(nodes.where("kind is not null"), "kind", F.col("kind")))
    out = out.unionByName(count(edges, "edge", F.col("edge_type")))
    return out.unionByName(count(nodes, "total", F.lit("nodes"))).unionByName(count(edges, "total", F.lit("edges")))


def consolidated(bodies: DataFrame) -> DataFrame:
    """(name, files) of functions (path, name, body) whose normalised body stands in two files or more."""
    same = F.sha2(F.regexp_replace("body", r"\s+", " "), 256)
    return bodies.groupBy("name", same.alias("digest")).agg(F.array_sort(F.collect_set("path")).alias("files")).where(F.size("files") >= 2).select("name", "files")
