"""Metrics, verdicts and diagnostics from text; names, calls and references between code parts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import states as S

NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"

# Names under which a measurement may stand, in order of preference.
ACCURACY = ["accuracy_score", "accuracy", "score", "success_rate", "precision"]
SECONDS = ["wall_seconds", "execution_time", "execution_seconds", "elapsed_seconds", "duration_seconds", "runtime_seconds"]
MILLIS = ["latency_ms", "wall_ms", "duration_ms"]
MICROS = ["latency_us", "wall_us", "duration_us"]
COMPRESSION = ["compression_ratio", "compression", "compaction_ratio", "minify_compression"]


def json_object(text: Column) -> Column:
    """The text if it is JSON, else its part from the first to the last brace, else null; as text."""
    whole = F.trim(text)
    part = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(whole), valid(part))


def parsed_metrics(rows: DataFrame, text: str = "out") -> DataFrame:
    """With wall_time, energy and accuracy: from JSON first, else from ``key=number`` or ``key: number``."""
    blob = json_object(F.col(text))
    value = lambda key: F.get_json_object(blob, f"$.{key}").try_cast("double")
    line = lambda key: F.nullif(F.regexp_extract(text, rf"(?i){key}\s*[=:]\s*({NUMBER})", 1), F.lit("")).try_cast("double")
    return rows.withColumns({
        "wall_time": F.coalesce(value("wall_time"), line("wall_time")),
        "energy": F.coalesce(value("energy"), line("energy")),
        "accuracy": F.coalesce(value("accuracy_error"), value("accuracy"), line("accuracy")),
    })


def objective_vector(rows: DataFrame, record: str = "record", success: str | None = "success") -> DataFrame:
    """With accuracy_score, inverse_wall_seconds and compression_ratio of a map of measurements."""
    first = lambda names: F.coalesce(*[F.try_element_at(F.col(record), F.lit(n)) for n in names])
    accuracy = first(ACCURACY) if success is None else F.coalesce(first(ACCURACY), F.col(success).cast("double"))
    seconds = F.coalesce(first(SECONDS), first(MILLIS) / 1e3, first(MICROS) / 1e6)
    return rows.withColumns({"accuracy_score": S.objective(accuracy), "inverse_wall_seconds": S.inverse_seconds(seconds), "compression_ratio": S.objective(first(COMPRESSION))})


# A line's verdict, and its error.
VERDICT = r"(?i)^\s*([\w./\-]+)\s*[:=]\s*(PASS|FAIL|OK|ERROR)\b"
ERROR = rf"(?i)^\s*([\w./\-]+)\s+.*?error\s*[=:]\s*({NUMBER})"


def validation_cases(rows: DataFrame, text: str = "out", tolerance: float = 1e-6) -> DataFrame:
    """(id, name, passed, error) of each line that holds a verdict, or an error to hold against the tolerance."""
    lines = rows.select("id", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    verdict, error = F.regexp_extract("line", VERDICT, 2), F.regexp_extract("line", ERROR, 2).try_cast("double")
    name = F.when(verdict != "", F.regexp_extract("line", VERDICT, 1)).otherwise(F.regexp_extract("line", ERROR, 1))
    passed = F.when(verdict != "", F.upper(verdict).isin("PASS", "OK")).otherwise(F.abs(error) <= tolerance)
    return lines.select("id", "n", name.alias("name"), passed.alias("passed"), F.when(verdict == "", error).alias("error")).where("passed is not null")


def validation_reports(rows: DataFrame, text: str = "out", code: str = "code", tolerance: float = 1e-6) -> DataFrame:
    """(id, cases, failed, passed): all cases hold; without any, the exit code decides."""
    cases = validation_cases(rows, text, tolerance).groupBy("id").agg(F.count("*").alias("cases"), F.count_if(~F.col("passed")).alias("failed"))
    both = rows.join(cases, "id", "left").na.fill(0, ["cases", "failed"])
    return both.select("id", "cases", "failed", F.when(F.col("cases") > 0, F.col("failed") == 0).otherwise(F.col(code) == 0).alias("passed"))


def positional_error(produced: DataFrame, reference: DataFrame, text: str = "out") -> DataFrame:
    """(id, max_error): largest relative error between the n-th numbers of two texts."""
    numbers = lambda df, n: df.select("id", F.posexplode(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))).alias("pos", "x")).select("id", "pos", F.col("x").try_cast("double").alias(n))
    both = numbers(produced, "got").join(numbers(reference, "ref"), ["id", "pos"])
    scale = F.when(F.abs("ref") > 1e-30, F.abs("ref")).otherwise(1.0)
    return both.groupBy("id").agg(F.max(F.abs(F.col("got") - F.col("ref")) / scale).alias("max_error"))


def test_counts(text: Column) -> Column:
    """(passed, failed) of a test run's summary line."""
    count = lambda word: F.coalesce(F.regexp_extract(text, rf"(\d+) {word}", 1).try_cast("long"), F.lit(0))
    return F.struct(count("passed").alias("passed"), count("failed").alias("failed"))


def key_values(text: Column) -> Column:
    """Map of a text's KEY=VALUE lines; of repeated keys the last."""
    own = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[A-Z_][A-Z0-9_]*=.+$"))
    pairs = F.transform(own, lambda x: F.struct(F.regexp_extract(x, "^([A-Z_][A-Z0-9_]*)=", 1).alias("key"), F.regexp_extract(x, "^[A-Z_][A-Z0-9_]*=(.+)$", 1).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def hot_groups(rows: DataFrame, fields: str, least: int = 2) -> DataFrame:
    """(label, weight): rows by their sorted field names, in groups of ``least`` or more."""
    names = F.array_sort(F.map_keys(fields))
    label = F.when(F.size(names) > 0, F.lower(F.array_join(names, "_"))).otherwise("raw")
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


# Faults of a Rust build.
METHOD = r"no method named `([^`]+)` found for [\w ]+ `([^`]+)`"
UNRESOLVED = r"unresolved import `([^`]+)`"


def rust_diagnoses(rows: DataFrame, text: str = "out") -> DataFrame:
    """(id, kind, name, receiver) of missing methods and unresolved imports."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(METHOD), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(METHOD), F.lit(2)).alias("b"))
    bare = F.regexp_replace(F.regexp_replace("m.b", r"^(&|mut\s+|\s)+", ""), r"<.*$", "")
    methods = rows.select("id", F.explode(pairs).alias("m")).select("id", F.lit("method_not_found").alias("kind"), F.col("m.a").alias("name"), bare.alias("receiver"))
    imports = rows.select("id", F.explode(F.regexp_extract_all(text, F.lit(UNRESOLVED), F.lit(1))).alias("name")).select("id", F.lit("unresolved_import").alias("kind"), "name", F.lit(None).cast("string").alias("receiver"))
    return methods.unionByName(imports)


def locked_versions(text: Column) -> Column:
    """Map of package to version of a lock file's text; of repeated packages the last."""
    block = r'(?s)\[\[package\]\]\s*name = "([^"]+)"\s*version = "([^"]+)"'
    names, versions = (F.regexp_extract_all(text, F.lit(block), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(names.alias("name"), versions.alias("version"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"]))
    return F.map_from_entries(last)


def rust_root_causes(rows: DataFrame, text: str = "out", declared: str = "declared", locked: str = "locked") -> DataFrame:
    """(id, kind, name, receiver, crate, resolved_version, declared_version): of each text the first fault.

    A missing method comes before an unresolved import. A path names its crate, as the declared
    dependency that it is with ``-`` for ``_``; a bare type is of the only dependency, if there
    is one. Versions are looked up in maps of name to version, declared and locked.
    """
    first = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    names = F.coalesce(F.map_keys(declared), F.array().cast("array<string>"))
    found = rows.withColumns({"method": first(METHOD, 1), "seen": first(METHOD, 2), "path": first(UNRESOLVED, 1)}).where("method is not null or path is not null")
    receiver = F.when(F.col("method").isNotNull(), F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("seen"), "^&+", ""), r"^\s*mut\s+", ""), "<.*$", ""))).otherwise(F.col("path"))
    found = found.withColumn("receiver", receiver).withColumn("head", F.substring_index("receiver", "::", 1))
    known = F.get(F.filter(names, lambda d: F.replace(d, F.lit("-"), F.lit("_")) == F.replace(F.col("head"), F.lit("-"), F.lit("_"))), F.lit(0))
    bare = F.when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise("")
    crate = F.when(F.col("method").isNull(), F.col("head")).when(F.contains("receiver", F.lit("::")), F.coalesce(known, "head")).otherwise(bare)
    found = found.withColumn("crate", crate)
    look = lambda m: F.coalesce(F.try_element_at(m, F.col("crate")), F.try_element_at(m, F.replace("crate", F.lit("-"), F.lit("_"))))
    kind = F.when(F.col("method").isNotNull(), "method_not_found").otherwise("unresolved_import")
    return found.select("id", kind.alias("kind"), F.col("method").alias("name"), "receiver", "crate", look(F.col(locked)).alias("resolved_version"), look(F.col(declared)).alias("declared_version"))


_SPAN = "struct<file_name:string,line_start:int,column_start:int,byte_start:bigint,byte_end:bigint,is_primary:boolean>"
_RUST = f"`$message_type` string, message string, level string, code struct<code:string>, spans array<{_SPAN}>"
_GCC = "array<struct<kind:string,message:string,option:string,locations:array<struct<caret:struct<file:string,line:int,column:int,`byte-column`:bigint>,finish:struct<`byte-column`:bigint>>>>>"


def rustc_messages(rows: DataFrame, text: str = "out", errors_only: bool = True) -> DataFrame:
    """Diagnostics of JSON lines, bare or in the build tool's envelope; at the primary span, else the first.

    Lines that are no JSON, of another message type, or without a span give none.
    """
    lines = rows.select("id", F.explode(F.split(text, r"\r?\n")).alias("raw")).where(F.ltrim("raw").startswith("{"))
    inner = F.when(F.get_json_object("raw", "$.reason") == "compiler-message", F.get_json_object("raw", "$.message")).otherwise(F.col("raw"))
    j = lines.select("id", F.from_json(inner, _RUST).alias("j")).select("id", "j.*")
    span = F.coalesce(F.get(F.filter("spans", lambda s: s["is_primary"]), F.lit(0)), F.get("spans", F.lit(0)))
    j = j.where(F.coalesce(F.col("$message_type"), F.lit("diagnostic")) == "diagnostic").withColumn("s", span).where("message is not null and s is not null")
    out = j.select(
        "id",
        F.lit("rustc").alias("source"),
        F.coalesce("level", F.lit("error")).alias("level"),
        F.col("code.code").alias("code"),
        "message",
        F.coalesce("s.file_name", F.lit("")).alias("file"),
        F.coalesce("s.line_start", F.lit(1)).alias("line"),
        F.coalesce("s.column_start", F.lit(1)).alias("column"),
        F.col("s.byte_start").alias("start_byte"),
        F.col("s.byte_end").alias("end_byte"),
    )
    return out.where("level = 'error'") if errors_only else out


def gcc_messages(rows: DataFrame, text: str = "out", errors_only: bool = True) -> DataFrame:
    """Diagnostics of JSON arrays, one a translation unit and line, at the first location's caret."""
    lines = rows.select("id", F.explode(F.split(text, r"\r?\n")).alias("raw")).where(F.ltrim("raw").startswith("["))
    d = lines.select("id", F.explode(F.from_json("raw", _GCC)).alias("d")).where("d is not null").select("id", "d.*").withColumn("at", F.get("locations", F.lit(0)))
    out = d.select(
        "id",
        F.lit("gcc").alias("source"),
        F.coalesce("kind", F.lit("error")).alias("level"),
        F.col("option").alias("code"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("at.caret.file", F.lit("")).alias("file"),
        F.coalesce("at.caret.line", F.lit(1)).alias("line"),
        F.coalesce("at.caret.column", F.lit(1)).alias("column"),
        F.col("at.caret.byte-column").alias("start_byte"),
        F.col("at.finish.byte-column").alias("end_byte"),
    )
    return out.where("level = 'error'") if errors_only else out


def compiler_messages(rows: DataFrame, text: str = "out", errors_only: bool = True) -> DataFrame:
    """(id, source, level, code, message, file, line, column, start_byte, end_byte) of either compiler's JSON."""
    return rustc_messages(rows, text, errors_only).unionByName(gcc_messages(rows, text, errors_only))


# What a diagnostic is about, by code or by parts of its message; the first that holds.
CATEGORIES = [
    ("pyo3_glob_import", "contains(msg, 'pymodule') and contains(msg, 'glob')"),
    ("missing_crate", "code in ('E0433', 'E0405')"),
    ("duplicate_definition", "code = 'E0428' or contains(msg, 'is defined multiple times')"),
    ("unresolved_parent_import", "(code = 'E0432' or contains(msg, 'unresolved import')) and contains(msg, 'super::')"),
    ("mismatched_slice_type", "code = 'E0308' and contains(raw, 'expected `&[') and contains(raw, 'found `&[[')"),
    (
        "missing_import",
        "code = 'E0432' or contains(msg, 'unresolved import') or contains(msg, 'could not be resolved') or contains(code, 'REPORTMISSINGIMPORTS')"
        " or contains(msg, 'is not defined') or contains(code, 'REPORTUNDEFINEDVARIABLE')",
    ),
    (
        "immutable_assignment",
        "code in ('E0384', 'E0594', 'E0596') or (contains(msg, 'cannot assign') and contains(msg, 'immutable')) or (contains(msg, 'cannot borrow') and contains(msg, 'as mutable'))",
    ),
    ("missing_semicolon", "contains(msg, concat('expected ', chr(39), ';', chr(39))) or contains(msg, 'expected semi') or code = 'EXPECTED_SEMICOLON' or (contains(msg, 'expected') and contains(msg, '`;`'))"),
]


def diagnosis_categories(messages: DataFrame) -> DataFrame:
    """``messages`` (code, message, ...) with ``category``, null where none holds."""
    views = {"code": "upper(coalesce(code, ''))", "msg": "lower(message)", "raw": "message"}
    rule = lambda text: re.sub(r"(?<![\w'`])(code|msg|raw)\b", lambda m: views[m[1]], text)
    return messages.withColumn("category", F.expr("case " + " ".join(f"when {rule(r)} then '{name}'" for name, r in CATEGORIES) + " end"))


def inferred_targets(names: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(name, language, role): by hints in the name, else by the most frequent language of its files, else python.

    A file (path) is of a target whose name has a part that stands in the path, language names aside.
    """
    rows = names.withColumn("language", S.language_of_name(F.col("name")))
    if files is not None:
        parts = F.filter(F.split(F.replace(F.lower("name"), F.lit("-"), F.lit("_")), "_"), lambda p: p != "")
        own = F.filter(parts, lambda p: ~p.isin(*S.LANGUAGE_WORDS))
        sought = rows.where("language = 'unknown'").select("name", F.explode(F.when(F.size(own) > 0, own).otherwise(parts)).alias("part"))
        known = F.create_map(*[x for e, ls in S.LANGUAGES_OF_EXTENSION.items() for x in (F.lit(e), F.array(*map(F.lit, ls)))])
        typed = files.select(F.lower("path").alias("path"), F.try_element_at(known, F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).alias("languages")).where("languages is not null")
        # Targets are a configuration's and few; files meet them by the parts of their paths' words.
        hits = typed.join(sought, F.contains("path", F.col("part"))).select("name", "path", F.explode("languages").alias("language")).distinct()
        votes = hits.groupBy("name", "language").agg(F.count("*").alias("n"))
        order = F.create_map(*[x for k, lang in enumerate(S.EXTENSION_ORDER) for x in (F.lit(lang), F.lit(-k))])
        best = votes.groupBy("name").agg(F.max_by("language", F.struct("n", order[F.col("language")])).alias("voted"))
        rows = rows.join(best, "name", "left").withColumn("language", F.when(F.col("language") == "unknown", F.coalesce("voted", F.lit("unknown"))).otherwise(F.col("language"))).drop("voted")
    rows = rows.withColumn("language", F.when(F.col("language") == "unknown", "python").otherwise(F.col("language")))
    return rows.withColumn("role", F.when(F.col("language").isin(S.COMPILED), "core").otherwise("binding"))


def boundaries(targets: DataFrame) -> DataFrame:
    """(provider, consumer, mechanism) between every core and every binding of a configuration's targets."""
    core = targets.where("role = 'core'").select(F.col("name").alias("provider"), F.col("language").alias("provider_language"))
    rest = targets.where("role = 'binding'").select(F.col("name").alias("consumer"))
    known = F.create_map(*[F.lit(x) for kv in S.MECHANISMS.items() for x in kv])
    return core.join(rest, F.lit(True)).select("provider", "consumer", F.coalesce(F.try_element_at(known, F.col("provider_language")), F.lit("cffi")).alias("mechanism"))


#: Names that go to all tasks at once.
NAMES = 20_000


def call_bridges(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(call, name): exported names within a call's text.

    A name lies in a text only if its first three characters do, so both are joined by those; shorter
    names are joined by each of their lengths.
    """
    least = 3
    names = names.select("name").distinct()
    # Few names go to all tasks; texts and their parts never do.
    meet = F.broadcast if names.limit(NAMES + 1).count() <= NAMES else lambda some: some.hint("merge")
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - least + 1, F.lit(1))), lambda k: F.substring(F.col("text"), k, F.lit(least)))
    grams = calls.select("call", "text", F.explode(F.array_distinct(keys)).alias("g"))
    long = grams.join(meet(names.where(F.length("name") >= least).withColumn("g", F.substring("name", 1, least))), "g")
    single = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(least - 1)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda k: F.substring(F.col("text"), k, n))))
    short = calls.select("call", "text", F.explode(F.array_distinct(single)).alias("g")).join(meet(names.where((F.length("name") < least) & (F.col("name") != "")).withColumn("g", F.col("name"))), "g")
    both = long.select("call", "text", "name").unionByName(short.select("call", "text", "name"))
    return both.where(F.contains("text", F.col("name"))).select("call", "name").distinct()


def def_use(assigned: DataFrame, used: DataFrame, by_file: bool = False) -> DataFrame:
    """(name, def_id, use_id): the last assignment of a name to all its uses, over files unless told otherwise."""
    keys = ["name", "file"] if by_file else ["name"]
    last = assigned.groupBy(*keys).agg(F.max_by("id", "seq").alias("def_id"))
    return used.select(*keys, F.col("id").alias("use_id")).join(last, keys).select("name", "def_id", "use_id")


def precision_advice(nodes: DataFrame) -> DataFrame:
    """(file, reason): the first of a file's nodes (by seq) that needs more precision."""
    rows = nodes.withColumn("reason", S.precision_reason(F.col("is_call"), F.col("name"), F.col("text"))).where("reason is not null")
    first = F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    return rows.withColumn("k", first).where("k = 1").select("file", "reason")


def semantic_hashes(nodes: DataFrame) -> DataFrame:
    """(file, hash) of the canonical kinds of named nodes in order, comments and signs left out."""
    category = S.node_category(F.col("language"), F.col("type"), F.col("named"), F.lit(False))
    kind = F.coalesce(S.canonical_kind(F.col("language"), F.col("type")), F.col("type"))
    rows = nodes.where("named").withColumn("category", category).where("category not in ('COMMENT', 'PUNCTUATION')").withColumn("kind", kind)
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"])
    return rows.groupBy("file").agg(F.sha2(F.array_join(kinds, "|").cast("binary"), 256).alias("hash"))


def branch_counts(nodes: DataFrame, branches: list[str]) -> DataFrame:
    """(function, complexity): one more than the branch nodes within each function's span.

    ``nodes`` is (file, id, type, start, stop); functions and branches meet within a file.
    """
    f = nodes.where("type = 'function'").select("file", F.col("id").alias("function"), F.col("start").alias("a"), F.col("stop").alias("b"))
    inner = nodes.where(F.col("type").isin(branches)).select("file", F.col("start").alias("s"), F.col("stop").alias("e"))
    within = f.join(inner, "file").where("s >= a and e <= b").groupBy("function").agg(F.count("*").alias("n"))
    return f.join(within, "function", "left").select("function", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("complexity"))


def best_source(rows: DataFrame, key: str, priority: dict[str, int]) -> DataFrame:
    """Of each key's rows (with ``origin``) the one of the first origin."""
    order = reduce(lambda c, kv: c.when(F.col("origin") == kv[0], kv[1]), priority.items(), F.when(F.lit(False), 0)).otherwise(len(priority))
    k = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, module, target) of Python imports (file, module) that a workspace's files (path) hold.

    Leading dots go up from the file's folder; a module is its file, else its package's.
    """
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    parts = F.filter(F.split(F.regexp_replace("module", r"^\.+", ""), r"\."), lambda p: p != "")
    folders = F.filter(F.split(F.regexp_replace("file", r"[^/]*$", ""), "/"), lambda p: p != "")
    base = F.when(dots > 0, F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    stem = F.array_join(F.concat(base, parts), "/")
    rows = imports.where(F.size(parts) > 0).select("file", "module", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.concat(stem, F.lit(".py")).alias("path")), F.struct(F.lit(1).alias("k"), F.concat(stem, F.lit("/__init__.py")).alias("path")))).alias("c"))
    hits = rows.select("file", "module", "c.k", "c.path").join(files.select("path"), "path")
    return hits.groupBy("file", "module").agg(F.min_by("path", "k").alias("target"))


def editor_commands(frames: DataFrame, actions: dict[str, str], text: str = "frame") -> DataFrame:
    """(id, action, code, symbol, file) of JSON-RPC diagnostics that are errors or warnings with a known code.

    A header block before an empty line is cut off; a missing severity is an error; the symbol is the
    message's first quoted word.
    """
    body = F.regexp_replace(text, r"(?s)^(?:[A-Za-z-]+:[^\n]*\n)+\r?\n", "")
    shape = "method string, params struct<uri:string,diagnostics:array<struct<severity:int,code:string,message:string>>>"
    rows = frames.withColumn("j", F.from_json(body, shape)).where("j.method = 'textDocument/publishDiagnostics'")
    each = rows.select("id", F.regexp_replace("j.params.uri", "^file://", "").alias("file"), F.explode("j.params.diagnostics").alias("d")).where(F.coalesce("d.severity", F.lit(1)) <= 2)
    known = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])
    symbol = F.regexp_extract("d.message", r"[`'\"]([^`'\"]+)[`'\"]", 1)
    return each.select("id", F.try_element_at(known, F.col("d.code")).alias("action"), F.col("d.code").alias("code"), symbol.alias("symbol"), "file").where("action is not null")
