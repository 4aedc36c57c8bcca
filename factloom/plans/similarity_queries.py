"""Neighbours, similar profiles and replayed trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kmeans as K
from ..operators import similarity as O
from ..operators.metric_index import MetricIndex
from ..session import load
from .registry import Fixture, query

_EUC = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)))"
_DOT = "list_sum(list_transform(list_zip({x}.embedding, {y}.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COS = f"1 - {_DOT.format(x='a', y='b')} / (sqrt({_DOT.format(x='a', y='a')}) * sqrt({_DOT.format(x='b', y='b')}))"
_KNN = """WITH d AS (SELECT b.vec_id AS probe, a.vec_id AS id, {d} AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0)
SELECT probe, id, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _nearest(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    probes = rows.where(F.col("id") % 20 == 0).withColumnRenamed("id", "probe")
    return O.nearest(rows, probes, 5, metric).withColumn("distance", F.round("distance", 6) + 0.0)


@query(_KNN.format(d=_EUC))
def knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of every twentieth vector among all."""
    return _nearest(spark, sf_dir, "euclidean")


@query(_KNN.format(d=_COS))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine")


_ALL = """WITH d AS (SELECT b.{id} AS id, a.{id} AS neighbour, {d} AS distance FROM {t} a, {t} b)
SELECT id, neighbour, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 5"""


def _index(spark: SparkSession, sf_dir: str, metric: str) -> MetricIndex:
    return MetricIndex(_vectors(spark, sf_dir), 5, metric)


@query(_ALL.format(id="vec_id", t="embeddings", d=_EUC))
def knn_index_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of every vector, by the index."""
    return _index(spark, sf_dir, "euclidean").neighbours().withColumn("distance", F.round("distance", 6) + 0.0)


@query(_ALL.format(id="vec_id", t="embeddings", d=_COS))
def knn_index_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, "cosine").neighbours().withColumn("distance", F.round("distance", 6) + 0.0)


def _part_index(spark: SparkSession, sf_dir: str) -> MetricIndex:
    d = lambda c: F.col(c).cast("double")
    rows = load(spark, sf_dir, "part").withColumn("p_k", F.col("p_partkey") % 97)
    return MetricIndex(rows.select(F.col("p_partkey").alias("id"), F.array(d("p_size"), d("p_retailprice"), d("p_k")).alias("vector")), 5)


_PART = " + ".join(f"({a} - {b}) ** 2" for a, b in (("a.p_size::DOUBLE", "b.p_size"), ("a.p_retailprice", "b.p_retailprice"), ("(a.p_partkey % 97)::DOUBLE", "b.p_partkey % 97")))


@query(_ALL.format(id="p_partkey", t="part", d=f"sqrt({_PART})"))
def knn_index_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of every part in space."""
    return _part_index(spark, sf_dir).neighbours().withColumn("distance", F.round("distance", 6) + 0.0)


@query()
def knn_index_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all distances between parts the index measured."""
    index = _part_index(spark, sf_dir)
    index.neighbours()
    return index.pruned()


_GRID = "CAST({x}.p_size AS DECIMAL(12, 2)), CAST({x}.p_retailprice AS DECIMAL(12, 2)), CAST({x}.p_partkey % 97 AS DECIMAL(12, 2))"
_SQUARE = " + ".join(f"(a{k} - b{k}) * (a{k} - b{k})" for k in range(3))


@query(
    f"""WITH a(id, a0, a1, a2) AS (SELECT p_partkey, {_GRID.format(x='part')} FROM part), b(probe, b0, b1, b2) AS (SELECT p_partkey, {_GRID.format(x='part')} FROM part WHERE p_partkey % 20 = 0)
SELECT probe, id, d::DOUBLE AS distance FROM (SELECT probe, id, {_SQUARE} AS d, row_number() OVER (PARTITION BY probe ORDER BY {_SQUARE}, id) AS k FROM a, b WHERE id <> probe) WHERE k = 1"""
)
def nearest_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other point in space, squared, in exact decimals."""
    # Hundredths are whole numbers, whose squares and sums are exact in doubles.
    d = lambda c: (F.col(c).cast("decimal(12,2)") * 100).cast("double")
    rows = load(spark, sf_dir, "part").withColumn("p_k", F.col("p_partkey") % 97)
    points = rows.select(F.col("p_partkey").alias("id"), F.array(d("p_size"), d("p_retailprice"), d("p_k")).alias("vector"))
    near = MetricIndex(points, 2).neighbours().where(F.col("id") % 20 == 0)
    near = near.select(F.col("id").alias("probe"), F.col("neighbour").alias("id"), (F.round(F.col("distance") * F.col("distance")) / 10_000).alias("distance"))
    # A point is its own nearest, or an equal one of smaller id is.
    other = near.where("id <> probe").withColumn("k", F.row_number().over(Window.partitionBy("probe").orderBy("distance", "id"))).where("k = 1")
    return other.select("probe", "id", "distance")


_PROFILE = """WITH p AS (SELECT l_orderkey AS id, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(value * value)) AS norm FROM p GROUP BY 1),
u AS (SELECT id, feature, value / norm AS u FROM p JOIN n USING (id))
SELECT * FROM (SELECT x.id AS a, y.id AS b, round(sum(x.u * y.u), 6) AS similarity FROM u x JOIN u y ON x.feature = y.feature AND x.id < y.id GROUP BY 1, 2) WHERE similarity >= 0.8"""


@query(_PROFILE)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose quantities are spread alike over parts."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("feature"), "l_quantity")
    # Dealt out by order, once for all steps that take profiles whole.
    return O.similar_pairs(rows.repartition("id").groupBy("id", "feature").agg(F.sum("l_quantity").alias("value")), 0.8)


@query(
    "WITH p AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier) SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM p a JOIN p b ON a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 5.0"
)
def proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return O.close_pairs(rows, ["x", "y"], 5.0).withColumn("distance", F.round("distance", 6))


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders")
    params = F.when(F.col("o_orderkey") % 3 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("price"), F.col("o_totalprice")))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("action"), F.col("o_totalprice").alias("result"), params.alias("params"),
        F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("cust"), F.col("o_custkey").cast("double")).alias("numbers"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("texts"),
    )


@query("SELECT o_orderkey AS id, o_totalprice AS result FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def replay_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.bounded(_trajectories(spark, sf_dir)).select("id", "result")


@query("SELECT o_orderkey AS id, o_totalprice AS result FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def replay_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.top(_trajectories(spark, sf_dir), 10, "O").select("id", "result")


@query("SELECT id FROM (SELECT o_orderkey AS id, o_totalprice AS r FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40) WHERE id % 3 <> 0 ORDER BY r DESC, id LIMIT 10")
def replay_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.best_matrices(_trajectories(spark, sf_dir), 10).select("id")


@query(
    """WITH s AS (SELECT o_orderkey AS id, o_totalprice AS result, round((greatest(0, 1 - abs(o_totalprice - 150000) / greatest(abs(o_totalprice), 150000, 1)) + greatest(0, 1 - abs(o_custkey - 700) / greatest(o_custkey, 700.0, 1)) + (o_orderpriority = '1-URGENT')::INT) / 3, 6) AS similarity FROM orders)
SELECT id, similarity FROM s ORDER BY similarity DESC, result DESC, id LIMIT 10"""
)
def replay_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trajectories(spark, sf_dir)
    score = F.round(O.state_similarity(F.col("numbers"), {"price": 150000.0, "cust": 700.0}, F.col("texts"), {"priority": "1-URGENT"}), 6)
    return rows.withColumn("similarity", score).orderBy(F.desc("similarity"), F.desc("result"), "id").limit(10).select("id", "similarity")


_W = """WITH m AS (SELECT l_returnflag || l_linestatus AS cluster, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), s AS (SELECT min(m) AS lo, sum(m) AS t, count(*) AS n FROM m),
w AS (SELECT cluster, CASE WHEN t - n * lo > 1e-12 THEN (m - lo) / (t - n * lo) ELSE 1.0 / n END AS weight FROM m, s)"""


@query(_W + " SELECT cluster, round(weight, 6) AS weight FROM w")
def cluster_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("cluster"), F.col("l_extendedprice").alias("fitness"))
    return O.cluster_weights(rows).withColumn("weight", F.round("weight", 6))


CENTRES = Fixture("cluster int, vector array<double>, weight double", [(0, [0.0, 0.0], 0.25), (1, [50.0, 1000.0], 0.75)])
_SCORE = f"SELECT p_partkey AS id, round(sum(weight / (1 + sqrt((p_size - vector[1]) ** 2 + (p_retailprice - vector[2]) ** 2))), 9) AS score FROM part, {CENTRES.sql} GROUP BY 1"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("vector"))
    return O.affinity(rows, CENTRES.frame(spark)).withColumn("score", F.round("score", 9))


@query(_SCORE)
def affinity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(f"SELECT id FROM ({_SCORE}) ORDER BY score DESC, id LIMIT 30")
def offspring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates with the best affinity."""
    return _scores(spark, sf_dir).orderBy(F.desc("score"), "id").limit(30).select("id")


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster) of a seeded k-means in 25 steps; draws have no SQL, a step has (below)."""
    return K.clusters(_vectors(spark, sf_dir), 8, seed=1, steps=25).select("id", "cluster")


_STEP = """a{n} AS (SELECT p.id, p.v, arg_min(c.cluster, ((p.x - c.x) ** 2 + (p.y - c.y) ** 2, c.cluster)) AS cluster, min((p.x - c.x) ** 2 + (p.y - c.y) ** 2) AS square
  FROM (SELECT id, x, y, 0 AS v FROM p) p, c{n} c GROUP BY 1, 2),
c{m} AS (SELECT cluster, avg(x) AS x, avg(y) AS y FROM a{n} JOIN p USING (id) GROUP BY 1 UNION ALL SELECT cluster, x, y FROM c{n} WHERE cluster NOT IN (SELECT cluster FROM a{n}))"""


@query(
    "WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part), c0 AS (SELECT (id - 1)::INT AS cluster, x, y FROM p WHERE id BETWEEN 1 AND 6),\n"
    + ",\n".join(_STEP.format(n=n, m=n + 1) for n in range(4))
    + "\nSELECT id, cluster, round(square, 4) AS square FROM a3"
)
def kmeans_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts after three of Lloyd's steps from the first six."""
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("vector"))
    first = np.array([r.vector for r in rows.where("id BETWEEN 1 AND 6").orderBy("id").collect()])
    return K.assigned(rows, K.lloyd(rows, first, 3)).select("id", "cluster", F.round("square", 4).alias("square"))


@query("SELECT DISTINCT round(p_retailprice, 0) AS price, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 2 = 0 AND round(b.p_retailprice, 0) = round(a.p_retailprice, 0) AND b.p_size = a.p_size) AND a.p_partkey % 2 = 1")
def unvisited_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded signatures of odd parts that no even part has."""
    signature = lambda k: load(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == k).select(F.round("p_retailprice", 0).alias("price"), "p_size").distinct()
    return signature(1).join(signature(0), ["price", "p_size"], "left_anti")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def capacity_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of capacity 3 for each customer keeps the highest."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return load(spark, sf_dir, "orders").withColumn("r", rank).where("r <= 3").select("o_custkey", "o_orderkey")
