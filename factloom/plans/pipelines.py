"""Whole runs made of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts, graph, stats
from ..sources import files


def classified(docs: DataFrame) -> DataFrame:
    """Documents (path, format, text) with their domain."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return T.with_domains(docs, stem, F.col("text"), F.col("format")).select(*docs.columns, "domain")


def invariants(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, edges, violations) of documents (path, format, text).

    One pass for each kind of document; names made unique by one window; edges by two joins.
    """
    from ..operators import code

    rows = classified(docs).withColumn("doc", F.col("path"))
    prose = facts.prose_facts(rows.where("format in ('text', 'pdf')"))
    data = facts.json_facts(rows.where("format = 'json'"))
    c_like = facts.c_facts(rows.where("format in ('code:c', 'code:cpp')"))
    py = code.python_facts(rows.where("format = 'code:python'"))
    python = py.select(F.col("path").alias("doc"), "kind", "symbol", F.lit(None).cast("string").alias("description"), "expression", "variables", F.col("value").alias("lo"), F.col("value").alias("hi"), "type_hint", "confidence")
    found = prose.unionByName(data).unionByName(c_like).unionByName(python)
    placed = found.join(rows.select("doc", "domain"), "doc").withColumn("seq", F.struct("doc", "kind", "symbol", F.coalesce("expression", F.lit(""))))
    named = facts.disambiguated(placed)
    edges = facts.reference_edges(named).unionByName(facts.shared_symbols(named).select("src", "dst", "edge_type"))
    return named, edges, facts.violations(named)


def export_invariants(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Reads a folder, writes facts and edges as JSON lines, and returns the documents' errors."""
    docs = files.documents(spark, folder)
    found, edges, wrong = invariants(docs.where("error is null"))
    files.write_graph(found.drop("seq"), edges, out)
    files.write_json(wrong.drop("seq"), f"{out}/violations")
    return docs.where("error is not null").select("path", "error")


def scan(sources: DataFrame, previous: DataFrame | None = None, threshold: float = 2.5) -> dict[str, DataFrame]:
    """Profiles, anomalies, duplicates and, against a previous scan, the differences of (path, text)."""
    from ..operators import delta

    profiles = sources.select("path", T.fingerprint(F.col("text")).alias("fingerprint"), *T.token_profile(F.col("text")))
    values = stats.unpivoted(profiles, ["path"], list(T.TOKEN_PATTERNS))
    out = {
        "profiles": profiles,
        "anomalies": stats.zscore_anomalies(values, stats.baseline(values), threshold, ("comment_line", "try_block", "except_block")),
        "duplicates": profiles.groupBy("fingerprint").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1),
    }
    if previous is not None:
        out["changes"] = delta.snapshot_diff(previous, profiles.select("path", "fingerprint"), "path", "fingerprint")
    return out


def build_plan(targets: DataFrame) -> DataFrame:
    """(name, stage) of targets (name, requires); a cycle raises, unknown requirements are no edges."""
    needs = targets.select("name", F.explode("requires").alias("r")).join(targets.select(F.col("name").alias("r")), "r")
    staged = graph.levels(needs.select(F.col("r").alias("src"), F.col("name").alias("dst")))
    lone = targets.select("name").join(staged, F.col("name") == F.col("node"), "left_anti").withColumn("stage", F.lit(0))
    return staged.select(F.col("node").alias("name"), F.col("level").alias("stage")).unionByName(lone)


#: What a registry holds of a source file.
REGISTRY = "context string, path string, language string, semantic_hash string, functions array<string>, types array<string>, version long"


def ingest(spark: SparkSession, folder: str, context: str, registry: DataFrame | None = None, language: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(registry, errors) after the sources of a folder, of one language if it is named: each file's semantic hash and symbols, keyed by context and path.

    A Python file is hashed by the types of its syntax nodes in order, a file of C or C++ by the
    kinds of its tokens, so white space and comments make no difference. Files that don't parse are errors
    and leave the registry as it was.
    """
    from ..operators import code, ledger

    docs = files.documents(spark, folder).where("format like 'code:%'").select("path", F.substring_index("format", ":", -1).alias("language"), F.coalesce("text", F.lit("")).alias("text"), "error")
    docs = docs.where(F.col("language") == language) if language else docs
    good = docs.where("error is null")
    python = good.where("language = 'python'")
    nodes = code.syntax_nodes(python)
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("id", "type"))), lambda n: n["type"])
    hashed = nodes.groupBy("path").agg(F.sha2(F.array_join(kinds, "\n").cast("binary"), 256).alias("semantic_hash"))
    now = registry if registry is not None else spark.createDataFrame([], REGISTRY)
    # One row; the version of this run.
    version = now.agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))
    read = hashed.join(code.python_symbols(python), "path").unionByName(code.outlines(good.where("language <> 'python'")))
    rows = read.join(docs.select("path", "language"), "path").crossJoin(F.broadcast(version))
    found = rows.select(F.lit(context).alias("context"), "path", "language", "semantic_hash", "functions", "types", (F.col("last") + 1).cast("long").alias("version"))
    errors = docs.join(read.select("path"), "path", "left_anti").select("path", F.coalesce("error", F.lit("does not parse")).alias("error"))
    return ledger.upserted(now, found, ["context", "path"], "version"), errors


def evolved(population: DataFrame, genes: dict[str, tuple[float, float]], objectives: dict[str, Column], size: int, generations: int, seed: int = 0, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(population, history) after so many generations of members (uid, genes), all objectives to be small.

    Members meet in pairs by two draws of hashes, in groups of bounded size; of each pair the better
    one (earlier front, more room) is a parent, and a child lies between two parents, moved a
    little, inside each gene's bounds. Parents and children are one population, of which the best ``size``
    by front and crowding stay. ``history`` is (generation, members, front, best of each
    objective); with ``path`` each generation is written there. Draws are hashes of uid, so a run
    doesn't depend on partitions.
    """
    from pyspark.sql import Window

    from ..operators import pareto
    from ..session import kept

    spark = population.sparkSession
    names = list(objectives)
    u = lambda *what: F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 40)).cast("double") / float(1 << 40)
    measured = lambda df: df.select("uid", *genes, *[c.alias(n) for n, c in objectives.items()])

    def ranked(df: DataFrame) -> DataFrame:
        return pareto.crowding(pareto.fronts(df, names), names, "front", "uid")

    def parents(df: DataFrame, generation: int, draw: int) -> DataFrame:
        """(group, place, genes): the better one of each two that a draw puts together."""
        groups = max(1, size // 128)
        drawn = df.withColumn("_d", F.xxhash64(F.lit(seed), F.lit(generation), F.lit(draw), "uid")).withColumn("group", F.pmod("_d", F.lit(groups)))
        nth = F.row_number().over(Window.partitionBy("group").orderBy("_d", "uid")) - 1
        better = F.min_by(F.struct(*genes), F.struct("front", (-F.col("crowding")).alias("c"), "uid"))
        return drawn.withColumn("place", F.floor(nth / 2)).groupBy("group", "place").agg(better.alias(f"p{draw}"))

    now = kept(ranked(measured(population)))
    told = None
    for g in range(generations):
        both = parents(now, g, 0).join(parents(now, g, 1), ["group", "place"])
        uid = F.xxhash64(F.lit(seed), F.lit(g), "group", "place")
        made = both.withColumn("uid", uid)
        for k, (gene, (low, high)) in enumerate(genes.items()):
            share, step = u(F.lit(g), F.lit(k), "uid"), u(F.lit(g), F.lit(-1 - k), "uid") - 0.5
            value = share * F.col(f"p0.{gene}") + (1 - share) * F.col(f"p1.{gene}") + step * (0.1 * (high - low))
            made = made.withColumn(gene, F.greatest(F.lit(low), F.least(F.lit(high), value)))
        whole = kept(now.select("uid", *genes, *names).unionByName(measured(made)).dropDuplicates(["uid"]))
        now = kept(pareto.select_best(ranked(whole), size, "uid"))
        if path:
            files.write_generation(now, g, path)
        line = now.agg(F.lit(g).alias("generation"), F.count("*").alias("members"), F.count_if(F.col("front") == 0).alias("front"), *[F.min(n).alias(f"best_{n}") for n in names])
        told = line if told is None else told.unionByName(line)
    if told is None:
        told = spark.createDataFrame([], "generation int, members long, front long, " + ", ".join(f"best_{n} double" for n in names))
    return now, told
