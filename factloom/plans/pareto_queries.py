"""Pareto fronts of parts: a low price and a large size (as its negative) are good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pareto as O
from ..operators import stats
from ..session import load
from .registry import query

XY = ["price", "minus_size"]
# A sweep by price: the tails are each front's least size so far, and a point is of the first front whose tail doesn't dominate it.
_FRONTS = """WITH p AS (SELECT p_partkey, p_retailprice AS price, -p_size::DOUBLE AS minus_size, p_size::DOUBLE AS size, p_brand FROM part),
l AS (SELECT list({'x': price, 'y': minus_size} ORDER BY price, minus_size) AS l FROM (SELECT DISTINCT price, minus_size FROM p)),
s AS (SELECT list_reduce(list_transform(l, lambda v: {'x': v.x, 'y': v.y, 'tails': []::DOUBLE[], 'out': []::BIGINT[]}),
  lambda a, v: {'x': v.x, 'y': v.y,
    'tails': a.tails[1:len(list_filter(a.tails, lambda t: t <= v.y))] || [v.y] || a.tails[len(list_filter(a.tails, lambda t: t <= v.y)) + 2:],
    'out': a.out || [len(list_filter(a.tails, lambda t: t <= v.y))::BIGINT]},
  {'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'tails': []::DOUBLE[], 'out': []::BIGINT[]}) AS s FROM l),
f AS (SELECT unnest(l).x AS price, unnest(l).y AS minus_size, unnest(s.out) AS front FROM l, s),
g AS (SELECT p.*, front::INT AS front FROM p JOIN f USING (price, minus_size))
"""
_CROWD = (
    _FRONTS
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY front) AS n,
lag(price) OVER a AS p1, lead(price) OVER a AS q1, lag(minus_size) OVER b AS p2, lead(minus_size) OVER b AS q2,
max(price) OVER (PARTITION BY front) - min(price) OVER (PARTITION BY front) AS s1, max(minus_size) OVER (PARTITION BY front) - min(minus_size) OVER (PARTITION BY front) AS s2
FROM g WINDOW a AS (PARTITION BY front ORDER BY price, p_partkey), b AS (PARTITION BY front ORDER BY minus_size, p_partkey)),
c AS (SELECT *, CASE WHEN n <= 2 OR p1 IS NULL OR q1 IS NULL OR p2 IS NULL OR q2 IS NULL THEN 'infinity'::DOUBLE
ELSE CASE WHEN s1 > 0 THEN (q1 - p1) / s1 ELSE 0 END + CASE WHEN s2 > 0 THEN (q2 - p2) / s2 ELSE 0 END END AS crowding FROM n)
"""
)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (-size).alias("minus_size"), size.alias("size"), "p_brand")


def _fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fronts(_points(spark, sf_dir), XY)


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.crowding(_fronts(spark, sf_dir), XY, "front", "p_partkey")


@query(
    "SELECT a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))"
)
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), (-F.col("p_size").cast("double")).alias("minus_size"))
    return O.frontier(rows, XY).select("p_partkey")


@query(
    "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity >= a.l_quantity AND b.l_discount >= a.l_discount AND b.l_extendedprice >= a.l_extendedprice AND (b.l_quantity > a.l_quantity OR b.l_discount > a.l_discount OR b.l_extendedprice > a.l_extendedprice))"
)
def pareto_frontier_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three objectives, maximized, over all line items."""
    cols = ["l_quantity", "l_discount", "l_extendedprice"]
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    return O.frontier(rows, cols, minimize=False).select("l_orderkey", "l_linenumber")


@query(_FRONTS + "SELECT p_partkey, front FROM g")
def pareto_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fronts(spark, sf_dir).select("p_partkey", "front")


@query()
def pareto_fronts_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts of all line items by three objectives, minimized; too many for SQL, tested against brute force."""
    cols = ["l_extendedprice", "l_discount", "l_tax"]
    return O.fronts(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols), cols).select("l_orderkey", "l_linenumber", "front")


@query(_CROWD + "SELECT p_partkey, CASE WHEN isinf(crowding) THEN -1.0 ELSE round(crowding, 6) END AS crowding FROM c")
def crowding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crowded(spark, sf_dir).select("p_partkey", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)).alias("crowding"))


@query(_CROWD + "SELECT p_partkey, front FROM c ORDER BY front, crowding DESC, p_partkey LIMIT 25")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.select_best(_crowded(spark, sf_dir), 25, "p_partkey").select("p_partkey", "front")


@query(_CROWD + "SELECT p_partkey FROM c WHERE front = 0 ORDER BY crowding DESC, p_partkey LIMIT 1")
def best_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.frontier(_points(spark, sf_dir), XY).withColumn("front", F.lit(0))
    return O.select_best(O.crowding(rows, XY, "front", "p_partkey"), 1, "p_partkey").select("p_partkey")


@query(
    """WITH n AS (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n, lag(p_retailprice) OVER a AS p1, lead(p_retailprice) OVER a AS q1, lag(p_size) OVER b AS p2, lead(p_size) OVER b AS q2,
max(p_retailprice) OVER (PARTITION BY p_brand) - min(p_retailprice) OVER (PARTITION BY p_brand) AS s1, max(p_size) OVER (PARTITION BY p_brand) - min(p_size) OVER (PARTITION BY p_brand) AS s2
FROM part WINDOW a AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), b AS (PARTITION BY p_brand ORDER BY p_size, p_partkey))
SELECT p_partkey, CASE WHEN n <= 2 OR p1 IS NULL OR q1 IS NULL OR p2 IS NULL OR q2 IS NULL THEN -1.0 ELSE round(CASE WHEN s1 > 0 THEN (q1 - p1) / s1 ELSE 0 END + CASE WHEN s2 > 0 THEN (q2 - p2) / s2 ELSE 0 END, 6) END AS crowding FROM n"""
)
def crowding_maximized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each brand, price and size both to be large."""
    rows = O.crowding(load(spark, sf_dir, "part"), ["p_retailprice", "p_size"], "p_brand", "p_partkey")
    return rows.select("p_partkey", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 6)).alias("crowding"))


@query(
    """WITH a AS (SELECT p_brand, p_size::DOUBLE AS x, max(p_retailprice) AS y FROM part WHERE p_size > 10 AND p_retailprice > 500 GROUP BY 1, 2),
b AS (SELECT *, coalesce(max(y) OVER (PARTITION BY p_brand ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 500) AS above FROM a)
SELECT p_brand, round(sum((x - 10) * greatest(0, y - above)), 4) AS hypervolume FROM b GROUP BY 1"""
)
def hypervolume_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("double"))
    return O.hypervolume_2d(rows, "size", "p_retailprice", (10.0, 500.0), "p_brand").withColumn("hypervolume", F.round("hypervolume", 4))


@query("SELECT p_brand, round(greatest(0, max(p_retailprice) - 500), 4) AS hypervolume FROM part GROUP BY 1")
def hypervolume_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.greatest(F.lit(0.0), F.max("p_retailprice") - 500), 4).alias("hypervolume"))


@query(
    """WITH p AS (SELECT DISTINCT p_brand, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey % 9)::DOUBLE AS z FROM part WHERE p_size > 0 AND p_retailprice > 900 AND p_partkey % 9 > 0),
zs AS (SELECT p_brand, z, z - coalesce(lead(z) OVER (PARTITION BY p_brand ORDER BY z DESC), 0) AS h FROM (SELECT DISTINCT p_brand, z FROM p)),
s AS (SELECT zs.p_brand, zs.z, h, x, max(y) AS y FROM zs JOIN p ON p.p_brand = zs.p_brand AND p.z >= zs.z GROUP BY ALL),
a AS (SELECT p_brand, z, h, x, y, coalesce(max(y) OVER (PARTITION BY p_brand, z ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 900) AS above FROM s)
SELECT p_brand, round(sum(h * x * greatest(0, y - above)), 3) AS hypervolume FROM a GROUP BY 1"""
)
def hypervolume_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 9).cast("double").alias("z"))
    return O.hypervolume_3d(rows, ("x", "y", "z"), (0.0, 900.0, 0.0), "p_brand").withColumn("hypervolume", F.round("hypervolume", 3))


@query(
    """WITH p AS (SELECT DISTINCT p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey % 97)::DOUBLE AS z FROM part WHERE p_size > 0 AND p_retailprice > 900 AND p_partkey % 97 > 0),
zs AS (SELECT z, z - coalesce(lead(z) OVER (ORDER BY z DESC), 0) AS h FROM (SELECT DISTINCT z FROM p)),
s AS (SELECT zs.z, h, x, max(y) AS y FROM zs JOIN p ON p.z >= zs.z GROUP BY ALL),
a AS (SELECT z, h, x, y, coalesce(max(y) OVER (PARTITION BY z ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 900) AS above FROM s)
SELECT round(sum(h * x * greatest(0, y - above)), 3) AS hypervolume FROM a"""
)
def hypervolume_3d_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as one group."""
    rows = load(spark, sf_dir, "part").select(F.lit(0).alias("g"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 97).cast("double").alias("z"))
    return O.hypervolume_3d(rows, ("x", "y", "z"), (0.0, 900.0, 0.0), "g").select(F.round("hypervolume", 3).alias("hypervolume"))


@query(
    """WITH s AS (SELECT min(p_retailprice) a, max(p_retailprice) b, min(p_size) c, max(p_size) d FROM part)
SELECT p_partkey, round(sqrt((1 - (p_retailprice - a) / (b - a)) ** 2 + (1 - (p_size - c) / (d - c)) ** 2), 6) AS distance FROM part, s ORDER BY round(sqrt((1 - (p_retailprice - a) / (b - a)) ** 2 + (1 - (p_size - c) / (d - c)) ** 2), 9), p_partkey LIMIT 1"""
)
def compromise_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.compromise(load(spark, sf_dir, "part"), ["p_retailprice", "p_size"], "p_partkey").select("p_partkey", F.round("distance", 6).alias("distance"))


@query(
    "(SELECT 'p_retailprice' AS objective, p_partkey AS member, p_retailprice AS value FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) UNION ALL (SELECT 'p_size', p_partkey, p_size::DOUBLE FROM part ORDER BY p_size DESC, p_partkey LIMIT 1)"
)
def objective_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.champions(load(spark, sf_dir, "part"), ["p_retailprice", "p_size"], "p_partkey")


@query("SELECT p_partkey, round(p_size * 0.5 + p_retailprice * 2.0, 6) AS score FROM part")
def weighted_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = stats.unpivoted(load(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"])
    return O.weighted_fitness(long, {"p_size": 0.5, "p_retailprice": 2.0}, "p_partkey").withColumn("score", F.round("score", 6))
