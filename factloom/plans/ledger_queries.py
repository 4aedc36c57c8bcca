"""Ledgers, upserts and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta as D
from ..operators import ledger as O
from ..session import load
from .registry import Fixture, of_suppliers, query

_CHAIN = """WITH RECURSIVE s AS (SELECT user_id, event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t FROM events WHERE user_id < 100000),
c AS (SELECT user_id, t, '' AS prev_hash, payload, sha256('|' || t || '|' || payload) AS block_hash FROM s WHERE t = 0
UNION ALL SELECT s.user_id, s.t, c.block_hash, s.payload, sha256(c.block_hash || '|' || s.t || '|' || s.payload) FROM c JOIN s ON s.user_id = c.user_id AND s.t = c.t + 1)
"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chained(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query(_CHAIN + "SELECT user_id, t::BIGINT AS t_causal, prev_hash, block_hash FROM c")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select("user_id", "t_causal", "prev_hash", "block_hash")


@query(_CHAIN + "SELECT user_id, t::BIGINT AS t_causal, 'content' AS fault FROM c WHERE t = 3 AND user_id % 10 = 0 AND payload <> 'forged'")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth block of every tenth chain has another payload than it was hashed with."""
    forged = (F.col("t_causal") == 3) & (F.col("user_id") % 10 == 0)
    rows = _ledger(spark, sf_dir).withColumn("payload", F.when(forged, "forged").otherwise(F.col("payload")))
    return O.chain_faults(rows, "user_id")


@query(_CHAIN + "SELECT user_id, t::BIGINT AS t_causal, CASE WHEN t = 2 THEN 'link' ELSE 'link' END AS fault FROM c WHERE user_id % 10 = 1 AND t = 2")
def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links only: the third block of some chains names another block before it."""
    cut = (F.col("t_causal") == 2) & (F.col("user_id") % 10 == 1)
    rows = _ledger(spark, sf_dir).withColumn("prev_hash", F.when(cut, "0").otherwise(F.col("prev_hash")))
    return O.chain_faults(rows, "user_id", content=False)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS weight FROM events")
def path_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return O.visit_weights(rows, ["user_id", "event_type"], ["event_id"]).select("event_id", "weight")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(1).alias("version"))
    changes = table.where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("segment"), F.lit(2).alias("version"))
    return O.upserted(table, changes, ["c_custkey"], "version")


@query("SELECT DISTINCT c_mktsegment AS context FROM customer")
def registry_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("context")).distinct()


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name").orderBy("c_name")


_DIFF = """WITH a AS (SELECT o_orderkey, sha256(o_orderstatus) AS f FROM orders WHERE o_orderkey % 10 <> 1),
b AS (SELECT o_orderkey, sha256(CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END) AS f FROM orders WHERE o_orderkey % 10 <> 2),
d AS (SELECT o_orderkey, CASE WHEN a.f IS NULL THEN 'created' WHEN b.f IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (o_orderkey) WHERE a.f IS DISTINCT FROM b.f)
"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    before = rows.where("o_orderkey % 10 <> 1").withColumn("f", F.sha2("o_orderstatus", 256))
    status = F.when(F.col("o_orderkey") % 10 == 3, "X").otherwise(F.col("o_orderstatus"))
    after = rows.where("o_orderkey % 10 <> 2").withColumn("f", F.sha2(status, 256))
    return D.snapshot_diff(before, after, "o_orderkey", "f")


@query(_DIFF + "SELECT o_orderkey, status FROM d")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(_DIFF + "SELECT status, count(*)::BIGINT AS n FROM d WHERE o_orderkey % 20 <> 3 GROUP BY 1")
def readonly_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = load(spark, sf_dir, "orders").where("o_orderkey % 20 = 3")
    return D.boundary_violations(_diff(spark, sf_dir), allowed, "o_orderkey").groupBy("status").agg(F.count("*").alias("n"))


_E = "name string, body string"
BASE = Fixture(_E, [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1"), ("f", "1"), ("g", "1")])
BASE = of_suppliers(BASE, "name")
LEFT = Fixture(_E, [("a", "1"), ("b", "2"), ("c", "1"), ("d", "2"), ("e", "2"), ("g", "2"), ("h", "9")])
LEFT = of_suppliers(LEFT, "name")
RIGHT = Fixture(_E, [("a", "1"), ("b", "1"), ("c", "3"), ("d", "2"), ("e", "3"), ("f", "4"), ("i", "8")])
RIGHT = of_suppliers(RIGHT, "name")


@query(
    BASE.answers("('a', '1', 'same'), ('b', '2', 'left'), ('c', '3', 'right'), ('d', '2', 'same'), ('e', '3', 'conflict'), ('f', '4', 'conflict'), ('g', '2', 'conflict'), ('h', '9', 'left'), ('i', '8', 'right')", "name, body, outcome")
)
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.three_way_merge(BASE.frame(spark, sf_dir), LEFT.frame(spark, sf_dir), RIGHT.frame(spark, sf_dir), ["name"], "body")


# A document's sentences as numbered lines. Left changes each sixth line, right each tenth, so each thirtieth is changed apart.
_LINE = "list_transform(string_split(coalesce(text, ''), '. '), lambda x, i: (i - 1) || ': ' || replace(x, chr(10), ' '))"


@query(
    f"""WITH d AS (SELECT doc_id, {_LINE} AS lines FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(lines, lambda x, i: CASE WHEN (i - 1) % 10 = 0 THEN x || ' right' WHEN (i - 1) % 6 = 0 THEN x || ' left' ELSE x END), chr(10))) AS merged_sha256,
((len(lines) + 29) // 30)::BIGINT AS conflicts FROM d"""
)
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of each text, merged line by line; the right side's lines where both changed."""
    parts = F.split(F.coalesce("text", F.lit("")), r"\. ")
    lines = F.transform(parts, lambda x, i: F.concat(i.cast("string"), F.lit(": "), F.translate(x, "\n", " ")))
    rows = load(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    version = lambda step, mark: F.array_join(F.transform("lines", lambda x, i: F.when(i % step == 0, F.concat(x, F.lit(mark))).otherwise(x)), "\n")
    rows = rows.select("doc_id", F.array_join("lines", "\n").alias("base"), version(6, " left").alias("left"), version(10, " right").alias("right"))
    return D.merged_texts(rows, "base", "left", "right").select("doc_id", F.sha2("merged", 256).alias("merged_sha256"), "conflicts")


NODES = Fixture("node int, cls string", [(1, "Add"), (2, "Num"), (3, "Num"), (4, "Dup")])
NODES = of_suppliers(NODES, "node")
PORTS = Fixture("node int, port string, target int", [(1, "left", 2), (1, "right", 3), (2, "out", 1), (3, "out", 1), (4, "in", None)])
PORTS = of_suppliers(PORTS, "node", "target")


@query(NODES.answers("(1, 'Add|2|left->Num,right->Num'), (2, 'Num|1|out->Add'), (3, 'Num|1|out->Add'), (4, 'Dup|1|in->-')", "node int, signature"))
def node_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.node_signatures(NODES.frame(spark, sf_dir), PORTS.frame(spark, sf_dir))


@query("SELECT event_id, sha256(user_id || '|' || event_type || '|' || event_id) AS state_hash FROM events")
def state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a state with its time."""
    return load(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", "user_id", "event_type", "event_id"), 256).alias("state_hash"))
