"""Populations, archives, caches and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import population as O
from ..session import load
from . import pipelines
from .registry import Fixture, Spread, of_parts, of_suppliers, query


def _half(spark: SparkSession, sf_dir: str, lo: int, hi: int) -> DataFrame:
    rows = load(spark, sf_dir, "part").where((F.col("p_partkey") % 10 >= lo) & (F.col("p_partkey") % 10 < hi))
    return rows.select(F.col("p_partkey").alias("uid"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))


@query("SELECT p_partkey AS uid, p_retailprice + CASE WHEN p_partkey % 10 >= 6 THEN 1 ELSE 0 END AS x FROM part")
def population_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of both keep the first's values."""
    second = _half(spark, sf_dir, 3, 10).withColumn("x", F.col("x") + 1)
    return O.merged(_half(spark, sf_dir, 0, 6), second).select("uid", "x")


@query("SELECT p_partkey AS uid FROM part a WHERE p_partkey % 10 < 5 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 10 >= 5 AND abs(b.p_retailprice - a.p_retailprice) <= 1e-9 AND b.p_size = a.p_size) UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 10 >= 5")
def archive_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.twins_replaced(_half(spark, sf_dir, 0, 5), _half(spark, sf_dir, 5, 10), ["x", "y"]).select("uid")


_SET = "(SELECT p_partkey AS uid, p_retailprice AS x, p_size::DOUBLE AS y FROM part WHERE p_partkey % 10 {})"
_TWINS = f"(SELECT * FROM {_SET.format('< 5')} a WHERE NOT EXISTS (SELECT 1 FROM {_SET.format('>= 5')} b WHERE abs(b.x - a.x) <= 1e-9 AND b.y = a.y) UNION ALL SELECT * FROM {_SET.format('>= 5')})"
_KEPT = """WITH p AS {}, f AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y))),
n AS (SELECT uid, count(*) OVER () AS n, lag(x) OVER a AS p1, lead(x) OVER a AS q1, lag(y) OVER b AS p2, lead(y) OVER b AS q2, max(x) OVER () - min(x) OVER () AS s1, max(y) OVER () - min(y) OVER () AS s2 FROM f WINDOW a AS (ORDER BY x, uid), b AS (ORDER BY y, uid))
SELECT uid FROM n ORDER BY CASE WHEN n <= 2 OR p1 IS NULL OR q1 IS NULL OR p2 IS NULL OR q2 IS NULL THEN 1e300 ELSE CASE WHEN s1 > 0 THEN (q1 - p1) / s1 ELSE 0 END + CASE WHEN s2 > 0 THEN (q2 - p2) / s2 ELSE 0 END END DESC, uid LIMIT 4"""


@query(_KEPT.format(_TWINS))
def archive_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.archived(_half(spark, sf_dir, 0, 5), _half(spark, sf_dir, 5, 10), ["x", "y"], ["x", "y"], 4).select("uid")


@query(_KEPT.format("(SELECT p_partkey AS uid, p_retailprice AS x, p_size::DOUBLE AS y FROM part)"))
def elites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.elites(_half(spark, sf_dir, 0, 6), _half(spark, sf_dir, 3, 10), ["x", "y"], 4).select("uid")


@query("SELECT o_orderkey AS uid FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice / 1000 - 100 >= -2.0 ORDER BY o_totalprice / 1000 - 100 DESC, o_orderkey LIMIT 40")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "REVERTED").otherwise("OK")
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), status.alias("status"), (F.col("o_totalprice") / 1000 - 100).alias("speed_gain"))
    return O.survivors(rows, 40).select("uid")


SEEDS = Fixture(
    "id int, coverage double, anomalies bigint, targets bigint, wall double, code bigint, comments bigint, failures bigint, ceiling bigint, other bigint",
    [(1, 0.96, 3, 50, 2.0, 400, 30, 5, 10, 7), (2, 1.0, 0, 0, None, 0, 0, None, 0, 8), (3, None, 9, 3, 1.0, 10, 40, 2, None, None), (4, 1.2, 0, 5, 0.0, 100, 0, 0, None, 4)],
)
SEEDS = of_parts(SEEDS, "id")


@query(
    f"""WITH a AS (SELECT id, coalesce(wall, 0) AS w, greatest(0.0, coalesce(coverage, 0) * (1 - least(1.0, coalesce(anomalies, 0) / greatest(coalesce(targets, 0), 1)) * 0.5)) AS a,
greatest(0.0, least(1.0, 1 - coalesce(comments, 0) / CASE WHEN code > 0 THEN code ELSE 1 END)) AS c, greatest(coalesce(anomalies, 0), coalesce(failures, 0)) AS m, coalesce(nullif(ceiling, 0), other, 0) AS l FROM {SEEDS.sql})
SELECT id, round(a, 6) AS score, round(least(1.0, a * 1.01), 6) AS third_accuracy, round(w * 0.95, 6) AS third_seconds, round(least(1.0, c * 1.01), 6) AS third_compression, round(CASE WHEN l > 0 THEN m / l ELSE 0 END, 6) AS anomaly_ratio FROM a"""
)
def seed_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score and the third row of the first population, and the share of anomalies."""
    seeds = O.seed_objectives(*[F.col(c) for c in ("coverage", "anomalies", "targets", "wall", "code", "comments")])
    rows = SEEDS.frame(spark, sf_dir).withColumn("s", seeds).withColumn("r", F.get("s.rows", F.lit(2)))
    third = [F.round(F.get("r", F.lit(k)), 6).alias(f"third_{n}") for k, n in enumerate(("accuracy", "seconds", "compression"))]
    return rows.select("id", "s.score", *third, F.round(O.anomaly_ratio(F.col("anomalies"), F.col("failures"), F.col("ceiling"), F.col("other")), 6).alias("anomaly_ratio"))


@query(
    """WITH d AS (SELECT r.round, p_partkey, p_retailprice AS x, row_number() OVER (PARTITION BY r.round ORDER BY md5('0:' || r.round || ':' || p_partkey), p_partkey) AS k FROM part, range(0, 20) r(round))
SELECT round::INT AS round, p_partkey AS winner FROM (SELECT *, row_number() OVER (PARTITION BY round ORDER BY x DESC, p_partkey) AS b FROM d WHERE k <= 3) WHERE b = 1"""
)
def tournament_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tournament(_half(spark, sf_dir, 0, 10), 20, 3, "uid", [F.desc("x")])


@query("SELECT l_orderkey, l_linenumber, least(0.06, greatest(0.02, l_discount)) AS rate, round_even(least(30.0, greatest(5.0, l_quantity)), 0)::BIGINT AS size FROM lineitem")
def clamped_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", O.clamped(F.col("l_discount"), 0.02, 0.06, "float").alias("rate"), O.clamped(F.col("l_quantity"), 5.0, 30.0, "int").alias("size"))


@query(
    """WITH s AS (SELECT member::INT AS member, 'p' || p_partkey AS name, p_partkey, p_size::DOUBLE AS high, p_retailprice, ('0x' || substring(md5('3:' || member || ':p' || p_partkey), 1, 10))::BIGINT / 1099511627776.0 AS u FROM part, range(0, 3) r(member))
SELECT member, name, CASE WHEN p_partkey % 5 = 0 THEN [high, p_retailprice][floor(u * 2)::INT + 1] WHEN p_partkey % 2 = 0 THEN round_even(u * high, 0) ELSE u * high END AS value FROM s"""
)
def sampled_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members of a parameter for each part, up to its size; every fifth has the parts' own size and price to choose from."""
    size = F.col("p_size").cast("double")
    some = F.when(F.col("p_partkey") % 5 == 0, F.array(size, "p_retailprice"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "int").otherwise("float")
    rows = load(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.lit(0.0).alias("low"), size.alias("high"), kind.alias("kind"), some.alias("choices"))
    return O.sampled(rows, 3, 3)


BLENDS = Fixture("id int, build map<string,double>, wall double, energy double", [(1, {"size": 3.0}, 2.0, None), (2, {"size": 1.0, "runtime_energy": 9.0}, 0.5, 4.0)])
BLENDS = of_parts(BLENDS, "id")


@query(BLENDS.answers("(0, 1, 'runtime_wall_time=1.0;size=3.0'), (1, 2, 'runtime_energy=2.0;runtime_wall_time=0.25;size=1.0')", "n, id int, objectives"))
def runtime_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = O.blended(F.col("build"), {"runtime_wall_time": F.col("wall"), "runtime_energy": F.col("energy")}, 0.5)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";")
    return BLENDS.frame(spark, sf_dir).select("id", shown.alias("objectives"))


@query("SELECT round(avg(n), 6) AS consensus FROM (SELECT l_suppkey, sqrt(sum(l_quantity * l_quantity)) AS n FROM lineitem GROUP BY 1)")
def consensus_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("w"))
    return O.consensus(rows).select(F.round("consensus", 6).alias("consensus"))


@query("SELECT sum((event_type <> 'error')::INT)::BIGINT AS hits, sum((event_type = 'error')::INT)::BIGINT AS misses, count(DISTINCT user_id)::BIGINT AS entries, avg((event_type <> 'error')::INT) AS hit_rate FROM events")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cache_statistics(load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_type") != "error").alias("hit")))


_T = "parent string, child string, next string"
PCS = [
    of_suppliers(Fixture(_T, rows), "parent")
    for rows in ([("p", "a", "b"), ("p", "b", None)], [("p", "a", "x@"), ("p", "b", None), ("q", "c", "d")], [("p", "a", "y@"), ("p", "b", None), ("q", "c", "d")])
]


@query(
    f"SELECT parent, child, l.next AS left_next, r.next AS right_next FROM (SELECT * FROM {PCS[1].sql} EXCEPT SELECT * FROM {PCS[0].sql}) l JOIN (SELECT * FROM {PCS[2].sql} EXCEPT SELECT * FROM {PCS[0].sql}) r USING (parent, child) WHERE l.next IS DISTINCT FROM r.next"
)
def successor_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.successor_conflicts(*[f.frame(spark, sf_dir) for f in PCS])


SITES = Fixture("site int, name string, text string", [(1, "add", "add(x)"), (2, "main", "scale <<<1, 2>>>(y); other<<<3>>>()"), (3, "scale", ""), (4, "none", "x << 3")])
SITES = of_parts(SITES, "site")


@query(f"SELECT site, name AS kernel FROM {SITES.sql} WHERE name IN ('add', 'scale') UNION SELECT site, k FROM (SELECT site, unnest(regexp_extract_all(text, '(\\w+)\\s*<<<', 1)) AS k FROM {SITES.sql}) WHERE k IN ('add', 'scale')")
def launch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.launch_edges(SITES.frame(spark, sf_dir), spark.createDataFrame([("add",), ("scale",)], "kernel string"))


DOCS = Fixture(
    "path string, format string, text string",
    [
        ("d@/genome.txt", "text", "DNA sequences encode genes and mutations.\nLet rate@ be the mutation rate observed in the genome.\n"),
        ("d@/game.txt", "text", "The render pipeline updates every frame in the game loop entity system.\nLet rate@ be the frame render rate for the game loop.\n"),
        ("d@/config.json", "json", '{"max_retries@": 3, "timeout@": 1.5}'),
        ("d@/engine.cpp", "code:cpp", "#define MAX_ENTITIES@ 1024\nconst float GRAVITY@ = 9.8;\nvoid tick() { assert(MAX_ENTITIES@ > 0); }\n"),
        ("d@/model.py", "code:python", "MAX_RETRIES@ = 3\ndef area@(radius):\n    return 3.14159 * radius * radius\n"),
    ],
)
DOCS = Spread(DOCS, [], value="s_suppkey")


@query(DOCS.answers("('genomics', 'genomics::rate@'), ('game_engine', 'game_engine::rate@'), ('general', 'general::max_retries@'), ('general', 'general::timeout@'), ('code:cpp', 'code:cpp::MAX_ENTITIES@'), ('code:cpp', 'code:cpp::GRAVITY@'), ('code:cpp', 'code:cpp::MAX_ENTITIES@'), ('code:python', 'code:python::MAX_RETRIES@'), ('code:python', 'code:python::area@')", "domain, fact_id"))
def invariants_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.invariants(DOCS.frame(spark, sf_dir))[0].select("domain", "fact_id")


@query(DOCS.answers("('genomics::rate@', 'game_engine::rate@', 'shared_symbol'), ('game_engine::rate@', 'genomics::rate@', 'shared_symbol')", "src, dst, edge_type"))
def invariants_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-domain edges; a boundary and a variable of one id are one node, so it refers not to itself."""
    return pipelines.invariants(DOCS.frame(spark, sf_dir))[1].where("edge_type = 'shared_symbol'")


@query("SELECT 'p' || p_partkey AS name, s::INT AS stage FROM (SELECT p_partkey, (SELECT count(*) FROM range(1, 62) r(k) WHERE p_partkey % (1::BIGINT << k) = 0) AS s FROM part WHERE p_partkey > 0)")
def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even part requires the half of it, so it waits for as many stages as it has twos; others require what isn't there."""
    part = load(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey")
    needs = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("p"), (F.col("p_partkey") / 2).cast("long").cast("string")))).otherwise(F.array(F.lit("gone")))
    return pipelines.build_plan(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), needs.alias("requires")))


@query("SELECT 'changed' AS status, count(*)::BIGINT AS n FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT 'created', count(*) FROM pages WHERE page_id % 7 = 1")
def scan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of all pages against an earlier one."""
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"), "page_id")
    old = rows.where("page_id % 7 <> 1").select("path", F.when(F.col("page_id") % 7 == 0, "old").otherwise(F.sha2("text", 256)).alias("fingerprint"))
    return pipelines.scan(rows, old)["changes"].groupBy("status").agg(F.count("*").alias("n"))


@query()
def evolved_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations of two genes that begin as the parts' sizes and prices; draws have no SQL, tested for what must hold."""
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("uid"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    aims = {"near": F.pow(F.col("a") - 20, 2) + F.pow(F.col("b") - 9, 2), "far": F.pow(F.col("a") - 30, 2) + F.col("b")}
    return pipelines.evolved(rows, {"a": (1.0, 50.0), "b": (0.0, 30.0)}, aims, 200, 3, seed=1)[1]
