"""Entropy, fingerprints, domains, profiles and n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extractors
from ..session import load
from .registry import Fixture, Spread, literal, of_parts, query

_TOKENS = "regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _entropy_sql(items: str, column: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, {items} AS items FROM documents),
t AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(items) AS x FROM d) GROUP BY 1, 2),
n AS (SELECT doc_id, sum(c) AS n FROM t GROUP BY 1),
e AS (SELECT doc_id, -sum((c / n) * log2(c / n)) AS h FROM t JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, round(CASE WHEN h > 0 THEN h ELSE 0.0 END, 6) AS {column} FROM documents LEFT JOIN e USING (doc_id)
"""


@query(_entropy_sql(_TOKENS, "token_entropy"))
def doc_token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(T.entropy(T.tokens(F.col("text"))), 6).alias("token_entropy"))


@query(_entropy_sql(_LINES, "line_entropy"))
def doc_line_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(T.entropy(T.lines(F.col("text"))), 6).alias("line_entropy"))


def entropy_gate(docs: DataFrame, least_token: float = 3.0, least_line: float = 2.5, least_diversity: float = 0.4) -> DataFrame:
    """Whether a text is diverse enough, with the reasons against it."""
    text = F.col("text")
    rows = docs.withColumns({"te": F.round(T.entropy(T.tokens(text)), 9), "le": F.round(T.entropy(T.lines(text)), 9), "sd": T.structural_diversity(text)})
    reasons = F.filter(
        F.array(F.when(F.col("te") < least_token, "token"), F.when(F.col("le") < least_line, "line"), F.when(F.col("sd") < least_diversity, "structure")),
        lambda x: x.isNotNull(),
    )
    return rows.select("*", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"), T.parameter_fingerprint(text).alias("parameters"))


@query(
    f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS tokens, {_LINES} AS lines, text FROM documents),
t AS (SELECT doc_id, round(-sum((c / n) * log2(c / n)), 9) AS te FROM (SELECT doc_id, x, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, unnest(tokens) AS x FROM d) GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT doc_id, round(-sum((c / n) * log2(c / n)), 9) AS le FROM (SELECT doc_id, x, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, unnest(lines) AS x FROM d) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT d.doc_id, coalesce(te, 0.0) AS te, coalesce(le, 0.0) AS le, text FROM d LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, te >= 3.0 AND le >= 2.5 AS passed,
       array_to_string(list_filter([CASE WHEN te < 3.0 THEN 'token' END, CASE WHEN le < 2.5 THEN 'line' END], lambda x: x IS NOT NULL), ',') AS reasons,
       substring(sha256(array_to_string(list_sort(regexp_extract_all(text, '"[^"]*"|\\b\\d+\\b')), '|')), 1, 16) AS parameters
FROM g
"""
)
def entropy_gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_gate(load(spark, sf_dir, "documents")).select("doc_id", "passed", "reasons", "parameters")


@query("SELECT doc_id, sha256(text) AS fingerprint, length(text)::BIGINT AS n_chars, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS line_count FROM documents")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    count = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    return load(spark, sf_dir, "documents").select("doc_id", T.fingerprint(text).alias("fingerprint"), F.length(text).cast("long").alias("n_chars"), count.alias("line_count"))


@query(
    """SELECT page_id, substring(sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '#[^\\n]*', '', 'g'), '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', ' ', 'g'))), 1, 32) AS semantic_fingerprint FROM pages"""
)
def page_semantic_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.semantic_fingerprint(F.col("html")).alias("semantic_fingerprint"))


@query("""SELECT page_id, substring(sha256(array_to_string(list_sort(regexp_extract_all(html, '"[^"]*"|\\b\\d+\\b')), '|')), 1, 16) AS parameters FROM pages""")
def page_parameter_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.parameter_fingerprint(F.col("html")).alias("parameters"))


@query(
    """WITH p AS (SELECT page_id, substring(sha256(array_to_string(list_sort(regexp_extract_all(html, '"[^"]*"|\\b\\d+\\b')), '|')), 1, 16) AS f FROM pages)
SELECT a.page_id, a.f <> b.f AS changed FROM p a JOIN p b ON b.page_id = a.page_id + 1"""
)
def parameter_recycling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's parameters differ from those of the page after it."""
    rows = load(spark, sf_dir, "pages").select("page_id", T.parameter_fingerprint(F.col("html")).alias("f"))
    after = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("f").alias("g"))
    return rows.join(after, "page_id").select("page_id", (F.col("f") != F.col("g")).alias("changed"))


DIVERSITY = Fixture(
    "id int, text string",
    [(1, "[task:a]\nrun x@\n[task:b]\nrun x@\n"), (2, "[task:a]\nneeds = b\nrun x\n[task:b]\nrun y"), (3, ""), (4, "head\n[task:a]\nrun"), (5, "no tasks")],
)
DIVERSITY = of_parts(DIVERSITY, "id")


@query(
    f"""WITH b AS (SELECT id, i, array_to_string(list_filter(list_transform(string_split(CASE WHEN i > 1 THEN '[task:' || x ELSE x END, chr(10)), lambda y: trim(y)), lambda y: y <> '' AND NOT starts_with(y, '[task:') AND NOT starts_with(y, 'needs =')), chr(10)) AS body
FROM (SELECT id, unnest(string_split(text, '[task:')) AS x, generate_subscripts(string_split(text, '[task:'), 1) AS i FROM {DIVERSITY.sql}))
SELECT f.id, round(coalesce(count(DISTINCT body) FILTER (body <> '') / nullif(count(*) FILTER (body <> ''), 0), 1.0), 6) AS diversity FROM {DIVERSITY.sql} f LEFT JOIN b USING (id) GROUP BY f.id"""
)
def structural_diversity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DIVERSITY.frame(spark, sf_dir).select("id", F.round(T.structural_diversity(F.col("text")), 6).alias("diversity"))


def _domain_sql() -> str:
    count = lambda w: f"(length(whole) - length(replace(whole, {literal(w)}, ''))) // {len(w)}"
    scores = ", ".join(f"({' + '.join(count(w) for w in words)})::BIGINT AS {d}" for d, words in T.DOMAIN_KEYWORDS.items())
    names = list(T.DOMAIN_KEYWORDS)
    best = " ".join(f"WHEN {n} = greatest({', '.join(names)}) AND {n} > 0 THEN '{n}'" for n in names)
    return f"WITH s AS (SELECT doc_id, {scores} FROM (SELECT doc_id, lower(source || ' ' || text) AS whole FROM documents)) SELECT *, CASE {best} ELSE 'general' END AS domain FROM s"


@query(_domain_sql())
def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return T.with_domains(rows, F.col("source"), F.col("text"), F.lit("text")).drop("source", "text")


def _profile_columns(text: str) -> str:
    """Counts of all patterns; ``=`` but not ``==`` for an engine without look-ahead, by another sign for ``==``."""
    out = []
    for k, p in T.TOKEN_PATTERNS.items():
        own = rf"regexp_replace({text}, '(^|[^:+\-*/|&^=])==', '\1' || chr(1) || chr(1), 'g')" if "(?!=)" in p else text
        out.append(f"len(regexp_extract_all({own}, {literal('(?m)' + p.replace('(?!=)', ''))}))::BIGINT AS {k}")
    return ", ".join(out)


@query(f"SELECT page_id, {_profile_columns('html')} FROM pages")
def page_token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", *T.token_profile(F.col("html")))


@query("SELECT " + ", ".join(f"sum({k})::BIGINT AS {k}" for k in T.TOKEN_PATTERNS) + f" FROM (SELECT {_profile_columns('html')} FROM pages)")
def token_profile_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select(*T.token_profile(F.col("html")))
    return rows.agg(*[F.sum(n).alias(n) for n in T.TOKEN_PATTERNS])


@query("SELECT fingerprint, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(text) AS fingerprint FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def event_ngrams(events: DataFrame, n: int = 4) -> DataFrame:
    """Runs of n event types of a user, counted. A run is made of lags, so no user's events are gathered."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    parts = [F.lag("event_type", k).over(order) for k in range(n - 1, 0, -1)]
    runs = events.select(*[p.alias(f"e{k}") for k, p in enumerate(parts)], "event_type").dropna()
    return runs.groupBy(F.concat_ws(" ", *[f"e{k}" for k in range(n - 1)], "event_type").alias("ngram")).agg(F.count("*").alias("n"))


_NGRAMS = """WITH g AS (SELECT lag(event_type, 3) OVER w || ' ' || lag(event_type, 2) OVER w || ' ' || lag(event_type, 1) OVER w || ' ' || event_type AS ngram
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT ngram, count(*)::BIGINT AS n FROM g WHERE ngram IS NOT NULL GROUP BY 1)
SELECT ngram, n FROM c"""


@query(_NGRAMS)
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ngrams(load(spark, sf_dir, "events"))


@query(_NGRAMS + " ORDER BY n DESC, ngram LIMIT 20")
def top_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ngrams(load(spark, sf_dir, "events")).orderBy(F.desc("n"), "ngram").limit(20)


SOURCES = Fixture(
    "path string, text string",
    [
        ("d@/a.py", "import os\n\n@wrap\ndef f(x):\n    # note\n    return x + 1\n\nclass A:\n    y = 'text'\n"),
        ("d@/b.py", "async def g():\n    try:\n        await h()\n    except E:\n        raise\n    return [i for i in range(3)]\n"),
        ("d@/c.py", "from os import path\nwith open(p) as f:\n    assert f, \"no\"\n    yield lambda: 0x1F\n"),
        ("d@/d.py", "a == b; c = d==e; f += 1; g: int = 2; h === i; j = k = 3\n"),
        ("d@/e.py", ""),
    ],
)
SOURCES = Spread(SOURCES, [], value="s_suppkey")


@query(f"SELECT path, {_profile_columns('text')} FROM {SOURCES.sql}")
def source_token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SOURCES.frame(spark, sf_dir).select("path", *T.token_profile(F.col("text")))


DELTAS = Fixture(
    "path string, old string, new string",
    [("a", "x\ny@\nz", "x\nz\nw@\nv"), ("b", "same", "same"), ("c", "", "one"), ("d", "p\np\nq", "q\np")],
)
DELTAS = of_parts(DELTAS, "path")


@query(
    f"""SELECT path, sha256(old) <> sha256(new) AS changed,
len(list_filter(list_distinct(string_split(new, chr(10))), lambda x: NOT list_contains(string_split(old, chr(10)), x) AND NOT (x = '' AND new = '')))::BIGINT AS lines_added,
len(list_filter(list_distinct(string_split(old, chr(10))), lambda x: NOT list_contains(string_split(new, chr(10)), x) AND NOT (x = '' AND old = '')))::BIGINT AS lines_removed,
(length(new) - length(old))::BIGINT AS size_delta FROM {DELTAS.sql}"""
)
def content_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two texts, over sets of lines; an empty text has no line."""
    own = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n"))
    return DELTAS.frame(spark, sf_dir).select(
        "path",
        (T.fingerprint(F.col("old")) != T.fingerprint(F.col("new"))).alias("changed"),
        F.size(F.array_except(own("new"), own("old"))).cast("long").alias("lines_added"),
        F.size(F.array_except(own("old"), own("new"))).cast("long").alias("lines_removed"),
        (F.length("new") - F.length("old")).cast("long").alias("size_delta"),
    )


# Words, numbers, quoted strings and signs, for an engine whose word class is ASCII's.
_TOKENS = literal(r"[A-Za-z_][\p{L}\p{N}_]*|\d+(?:\.\d+)?|\"[^\"\n]*\"|'[^'\n]*'|[^\s\p{L}\p{N}_]")


@query(
    f"""SELECT doc_id, kind, count(*)::BIGINT AS n FROM (SELECT doc_id, CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'identifier' WHEN regexp_matches(t, '^[0-9]') THEN 'number'
WHEN length(t) > 1 AND t[1] IN ('"', chr(39)) OR t IN ('"', chr(39)) THEN 'string' ELSE 'punctuation' END AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_TOKENS})) AS t FROM documents)) GROUP BY 1, 2"""
)
def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text by kind, by a table function joined laterally."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text")
    return extractors.extracted(rows, extractors.tokens, extractors.TOKENS).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
