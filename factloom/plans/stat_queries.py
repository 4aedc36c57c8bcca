"""Baselines, anomalies, drift and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import states as S
from ..operators import stats as O
from ..session import load
from .registry import Fixture, of_parts, query

METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{m}' AS metric, {m} AS value FROM lineitem" for m in METRICS)
_BASE = f"WITH v AS ({_LONG}), b AS (SELECT metric, avg(value) AS mean, CASE WHEN count(value) = 1 THEN 1.0 ELSE stddev_samp(value) END AS stdev, count(value) AS n FROM v GROUP BY 1)"
_ANOM = ", a AS (SELECT *, (value - mean) / stdev AS zscore FROM v JOIN b USING (metric)), x AS (SELECT *, CASE WHEN abs(zscore) > 3.2 THEN 'critical' ELSE 'warning' END AS severity FROM a WHERE (metric = 'l_tax' AND zscore < -1.6) OR (metric <> 'l_tax' AND zscore > 1.6))"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.unpivoted(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], METRICS)


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _values(spark, sf_dir)
    return O.zscore_anomalies(values, O.baseline(values), 1.6, ("l_tax",))


@query(_BASE + " SELECT metric, round(mean, 6) AS mean, round(stdev, 6) AS stdev, n FROM b")
def metric_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.baseline(_values(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query(_BASE + _ANOM + " SELECT l_orderkey, l_linenumber, metric, round(zscore, 4) AS zscore, severity FROM x")
def zscore_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(spark, sf_dir).select("l_orderkey", "l_linenumber", "metric", F.round("zscore", 4).alias("zscore"), "severity")


@query(_BASE + _ANOM + " SELECT metric, severity, count(*)::BIGINT AS n FROM x GROUP BY 1, 2")
def anomaly_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(spark, sf_dir).groupBy("metric", "severity").agg(F.count("*").alias("n"))


@query(_BASE + _ANOM + " SELECT l_orderkey, l_linenumber, metric FROM x ORDER BY abs(round(zscore, 6)) DESC, l_orderkey, l_linenumber, metric LIMIT 50")
def anomaly_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _anomalies(spark, sf_dir).withColumn("zscore", F.round("zscore", 6))
    return O.most_anomalous(rows, 50, ["l_orderkey", "l_linenumber", "metric"]).select("l_orderkey", "l_linenumber", "metric")


@query("SELECT greatest(50, floor(count(*) * 0.05)::INT, 0, 1) AS ceiling FROM documents")
def anomaly_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").agg(O.anomaly_ceiling(F.count("*")).alias("ceiling"))


@query("SELECT o_orderstatus AS status, round(count(*) / sum(count(*)) OVER (), 6) AS ratio, count(*) / sum(count(*)) OVER () >= 0.95 AS passes FROM orders GROUP BY 1")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each status among all rows and the gate of 0.95."""
    counts = load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", F.round(F.col("n") / F.col("total"), 6).alias("ratio"), (F.col("n") / F.col("total") >= 0.95).alias("passes"))


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS parameter, round(CASE WHEN count(*) > 20 THEN abs(corr({p}, l_extendedprice)) ELSE 0.0 END, 6) AS importance FROM lineitem" for p in ("l_quantity", "l_discount", "l_tax")) + ")"
)
def param_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.importance(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").withColumn("importance", F.round("importance", 6))


@query(
    """WITH b AS (SELECT c_mktsegment AS key, avg(c_acctbal) AS base FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), c AS (SELECT c_mktsegment AS key, avg(c_acctbal) AS cur FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1)
SELECT key, round(abs(coalesce(cur, 0) - coalesce(base, 0)) / abs(CASE WHEN coalesce(base, 0) = 0 THEN 1 ELSE base END), 6) AS drift, abs(coalesce(cur, 0) - coalesce(base, 0)) / abs(CASE WHEN coalesce(base, 0) = 0 THEN 1 ELSE base END) > 0.3 AS exceeds FROM b FULL JOIN c USING (key)"""
)
def parameter_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda k: load(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == k).groupBy(F.col("c_mktsegment").alias("key")).agg(F.avg("c_acctbal").alias("value"))
    return O.drift(own(0), own(1)).select("key", F.round("drift", 6).alias("drift"), "exceeds")


_KIN = """WITH s AS (SELECT user_id, event_id, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0.0 ELSE floor(value / 100) END AS v FROM events),
k AS (SELECT *, row_number() OVER w AS step, lag(v, 1) OVER w AS b, lag(v, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, coalesce(v - b, 0.0) AS velocity, CASE WHEN step >= 3 THEN (v - b) - (b - c) ELSE 0.0 END AS acceleration FROM k),
m AS (SELECT *, step - coalesce(max(CASE WHEN NOT (step >= 3 AND abs(velocity) < 0.005 AND abs(acceleration) < 0.005) THEN step END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS stall FROM d)
"""


def _kinetics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") / 100).cast("double").alias("score"))
    return O.kinetics(rows, "user_id", ["event_id"], "score")


@query(_KIN + "SELECT event_id, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, stall FROM m")
def score_kinetics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinetics(spark, sf_dir).select("event_id", F.round("velocity", 6).alias("velocity"), F.round("acceleration", 6).alias("acceleration"), "stall")


@query(_KIN + "SELECT user_id, max(stall) AS longest, sum((stall >= 15)::INT)::BIGINT AS stagnant FROM m GROUP BY 1")
def stall_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinetics(spark, sf_dir).groupBy("user_id").agg(F.max("stall").alias("longest"), F.sum(F.col("stagnant").cast("long")).alias("stagnant"))


@query(
    "SELECT user_id, n, round(list_reduce(list_prepend(0.0::DOUBLE, l), lambda a, x: 0.1 * x + 0.9 * a), 6) AS ema FROM (SELECT user_id, count(*) AS n, list(value::DOUBLE ORDER BY event_id) AS l FROM events GROUP BY 1)"
)
def ema_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.moving_average(load(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("ema", F.round("ema", 6))


@query(
    """WITH b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS improved FROM events)
SELECT event_id, (step - coalesce(max(CASE WHEN improved THEN step END) OVER (PARTITION BY user_id ORDER BY event_id), 0))::BIGINT AS idle FROM b"""
)
def stagnation_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.without_improvement(load(spark, sf_dir, "events"), "user_id", ["event_id"], "value").select("event_id", "idle")


_CYCLES = "(SELECT o_orderkey % 1000 AS cycle FROM orders)"


@query(
    f"""WITH c AS (SELECT cycle, greatest(cycle - 50, 0)::DOUBLE AS pos FROM {_CYCLES}), k AS (SELECT *, floor(log2(pos / 100 + 1) + 1e-12) AS k FROM c)
SELECT cycle::BIGINT AS cycle,
round(CASE WHEN cycle < 50 THEN 0.00001 + 0.00999 * (cycle / 50.0) ELSE greatest(0.00001, 0.01 * 0.995 ** (cycle - 50)) END, 8) AS exponential,
round(CASE WHEN cycle < 50 THEN 0.00001 + 0.00999 * (cycle / 50.0) ELSE greatest(0.00001, 0.01 * 0.5 ** floor((cycle - 50) / 100)) END, 8) AS step,
round(CASE WHEN cycle < 50 THEN 0.00001 + 0.00999 * (cycle / 50.0) ELSE greatest(0.00001, 0.00001 + 0.00999 * 0.5 * (1 + cos(pi() * (pos - 100 * (2.0 ** k - 1)) / (100 * 2.0 ** k)))) END, 8) AS cosine FROM k"""
)
def anneal_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).cast("long").alias("cycle"))
    c = F.col("cycle")
    return rows.select("cycle", F.round(S.exponential_rate(c), 8).alias("exponential"), F.round(S.step_rate(c), 8).alias("step"), F.round(S.cosine_rate(c), 8).alias("cosine"))


@query(
    """WITH n AS (SELECT o_custkey, o_orderkey, (o_totalprice / 1000) * 0.97 ** 3 - ((o_orderkey % 7) + 0.02 * 2) AS nb FROM orders)
SELECT o_orderkey, round(nb, 6) AS net_benefit, row_number() OVER (PARTITION BY o_custkey ORDER BY round(nb, 6) DESC, o_orderkey) - 1 AS rank_order FROM n"""
)
def action_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = F.round(S.net_benefit(F.col("o_totalprice") / 1000, F.col("o_orderkey") % 7, F.lit(3), F.lit(2)), 6)
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", nb.alias("net_benefit"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("net_benefit"), "o_orderkey")) - 1
    return rows.select("o_orderkey", "net_benefit", rank.cast("long").alias("rank_order"))


STATES = Fixture("raw string", [(x,) for x in ("R", "pd", " CG ", "CD", "F", "TO", "NF", "Q", "H", "E", "B", "C", "odd@", "", "CA")])
STATES = of_parts(STATES)


@query(
    f"""SELECT raw, CASE upper(trim(raw)) WHEN 'R' THEN 'RUNNING' WHEN 'PD' THEN 'PENDING' WHEN 'CG' THEN 'RUNNING' WHEN 'CD' THEN 'COMPLETED' WHEN 'F' THEN 'FAILED' WHEN 'TO' THEN 'TIMEOUT' WHEN 'NF' THEN 'NODE_FAIL' WHEN 'Q' THEN 'PENDING' WHEN 'H' THEN 'PENDING' WHEN 'E' THEN 'RUNNING' WHEN 'B' THEN 'RUNNING' WHEN 'C' THEN 'COMPLETED' WHEN 'CA' THEN 'CANCELLED' WHEN '' THEN 'UNKNOWN' ELSE upper(trim(raw)) END AS state FROM {STATES.sql}"""
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STATES.frame(spark, sf_dir).select("raw", S.job_state(F.col("raw")).alias("state"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 1e9 ELSE least(1e9, 1 / l_discount) END AS inverse, least(l_tax, 1e9) AS objective FROM lineitem")
def inverse_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.inverse_seconds(F.col("l_discount")).alias("inverse"), S.objective(F.col("l_tax")).alias("objective"))


@query("SELECT avg(o_totalprice)::DOUBLE AS mean, max(o_totalprice) AS best, count(*)::BIGINT AS size, sum((o_totalprice > 200000)::INT)::BIGINT AS above FROM orders")
def replay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").agg(F.avg(price).alias("mean"), F.max(price).alias("best"), F.count("*").alias("size"), F.count_if(price > 200000).alias("above"))


@query("SELECT 'p_retailprice' AS objective, avg(p_retailprice) AS mean, max(p_retailprice) AS high, min(p_retailprice) AS low FROM part UNION ALL SELECT 'p_size', avg(p_size), max(p_size), min(p_size) FROM part")
def objective_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.unpivoted(load(spark, sf_dir, "part"), ["p_partkey"], ["p_retailprice", "p_size"])
    return rows.groupBy(F.col("metric").alias("objective")).agg(F.avg("value").alias("mean"), F.max("value").alias("high"), F.min("value").alias("low"))


@query("WITH h AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last, arg_min(o_totalprice, o_orderkey) AS first, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round(best - last, 6) AS gap, n >= 2 AND abs(best - last) <= 1000 AS converged FROM h")
def convergence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of a series' last value from its best, and whether it is small."""
    rows = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last"), F.max("o_totalprice").alias("best"), F.count("*").alias("n"))
    gap = F.col("best") - F.col("last")
    return rows.select("o_custkey", F.round(gap, 6).alias("gap"), ((F.col("n") >= 2) & (F.abs(gap) <= 1000)).alias("converged"))
