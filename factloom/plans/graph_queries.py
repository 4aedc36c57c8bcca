"""Graphs made of keys: levels, closure, cycles, degrees and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import graph as O
from ..operators.skew import spread_join
from ..session import load, tasks_for
from .registry import Fixture, of_suppliers, query

# A DAG over parts: p points at 2p, 3p and 5p.
_EDGES = "(SELECT p_partkey AS src, p_partkey * k AS dst FROM part, (VALUES (2), (3), (5)) v(k) WHERE p_partkey > 0 AND p_partkey * k <= (SELECT max(p_partkey) FROM part))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey")
    top = part.agg(F.max("p_partkey").alias("top"))
    factor = F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))
    rows = part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), factor.alias("k")).withColumn("dst", F.col("src") * F.col("k"))
    return rows.crossJoin(F.broadcast(top)).where("dst <= top").select("src", "dst")  # one row


_LEVELS = f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node),
l AS (SELECT node, max(level)::INT AS level FROM r GROUP BY 1)
"""


@query(_LEVELS + "SELECT node, level FROM l")
def wavefront_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.levels(_edges(spark, sf_dir))


@query(_LEVELS + "SELECT a.level AS from_level, b.level AS to_level, count(*)::BIGINT AS n FROM e JOIN l a ON a.node = e.src JOIN l b ON b.node = e.dst WHERE a.level <> b.level GROUP BY 1, 2")
def wave_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return O.crossing_edges(edges, O.levels(edges)).groupBy("from_level", "to_level").agg(F.count("*").alias("n"))


_CLOSURE = f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), c AS (SELECT 7::BIGINT AS node UNION SELECT dst FROM c JOIN e ON e.src = c.node)\n"


# Edges whose ends add up to a multiple of 97 go, and part p points at 7 p + 1 where p is a multiple of 50.
_CHANGED = f"(SELECT src, dst FROM {_EDGES} WHERE (src + dst) % 97 <> 0 UNION SELECT p_partkey, p_partkey * 7 + 1 FROM part WHERE p_partkey % 50 = 0 AND p_partkey * 7 + 1 <= (SELECT max(p_partkey) FROM part))"


@query(_LEVELS.replace(_EDGES, _CHANGED) + "SELECT node, level FROM l")
def repaired_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels after some edges went and others came, from the levels before."""
    edges = _edges(spark, sf_dir)
    gone = edges.where((F.col("src") + F.col("dst")) % 97 == 0)
    part = load(spark, sf_dir, "part").select("p_partkey")
    new = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 7 + 1).alias("dst"))
    new = new.crossJoin(F.broadcast(part.agg(F.max("p_partkey").alias("top")))).where("dst <= top").select("src", "dst")  # one row
    after = edges.where((F.col("src") + F.col("dst")) % 97 != 0).unionByName(new)
    return O.repaired_levels(O.levels(edges), after, new, gone).select("node", "level")


@query(_CLOSURE + "SELECT node FROM c")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reachable(_edges(spark, sf_dir), spark.createDataFrame([(7,)], "node long")).select("node")


@query(_CLOSURE + "SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT node FROM c)")
def closure_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached parts that stay when part 7 has a new fingerprint and part 11 the old one."""
    cache = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.sha2("p_name", 256).alias("fingerprint"))
    same = cache.where("key = 11")
    new = spark.createDataFrame([(7, "new")], "key long, fingerprint string").unionByName(same)
    return O.invalidated(cache, _edges(spark, sf_dir), new).select("key")


CYCLES = Fixture("g string, src string, dst string", [("dag", "a", "b"), ("dag", "a", "c"), ("dag", "b", "d"), ("dag", "c", "d"), ("loop", "a", "b"), ("loop", "b", "c"), ("loop", "c", "a"), ("self", "x", "x")])
CYCLES = of_suppliers(CYCLES, "g")


@query(
    f"""WITH RECURSIVE r AS (SELECT g, src, dst FROM {CYCLES.sql} UNION SELECT r.g, r.src, e.dst FROM r JOIN {CYCLES.sql} e ON e.g = r.g AND e.src = r.dst)
SELECT g, bool_or(src = dst) AS cyclic FROM r GROUP BY 1"""
)
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs side by side are one graph of pairs; those with a node that no level takes are cyclic."""
    edges = CYCLES.frame(spark, sf_dir)
    names = edges.select("g").distinct()
    left = O.cyclic_part(edges.select(F.struct("g", F.col("src").alias("n")).alias("src"), F.struct("g", F.col("dst").alias("n")).alias("dst")))
    cyclic = left.select(F.col("src.g").alias("g")).distinct().withColumn("cyclic", F.lit(True))
    return names.join(cyclic, "g", "left").na.fill(False, ["cyclic"])


LOOPS = Fixture("src string, dst string", [("x", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("c", "y"), ("p", "q"), ("q", "p"), ("y", "z")])
LOOPS = of_suppliers(LOOPS, "src", "dst")


@query("SELECT v.node || '-' || (SELECT min(s_suppkey::VARCHAR) FROM supplier) AS node, v.place FROM (VALUES ('b', 0), ('c', 1), ('a', 2)) v(node, place)")
def cycle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle among others and ways that lead in and out, from its least node on."""
    shown = O.one_cycle(LOOPS.frame(spark, sf_dir))
    return shown.select(F.col("node"), F.pmod(F.col("place") + 2, F.lit(3)).alias("place"))


WIRES = Fixture("src string, src_port string, dst string, dst_port string", [("a", "out", "b", "in"), ("a", "out", "c", "in"), ("b", "out", "c", "in"), ("c", "out", "a", "in")])
WIRES = of_suppliers(WIRES, "src", "dst")
PORTS = Fixture("node string, port string, type string", [("a", "out", "int"), ("a", "in", None), ("b", "in", "int"), ("b", "out", "text"), ("c", "in", "text"), ("c", "out", "int")])
PORTS = of_suppliers(PORTS, "node")


@query(f"SELECT w.*, a.type AS expected, b.type AS actual FROM {WIRES.sql} w JOIN {PORTS.sql} a ON a.node = w.src AND a.port = w.src_port JOIN {PORTS.sql} b ON b.node = w.dst AND b.port = w.dst_port WHERE a.type <> b.type")
def type_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.type_violations(WIRES.frame(spark, sf_dir), PORTS.frame(spark, sf_dir))


_GRAPHS = "g string, src string, dst string"
_TRIANGLE, _PATH = [("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "c")]
BEFORE = of_suppliers(Fixture(_GRAPHS, [(g, *e) for g, es in (("cut", _TRIANGLE), ("same", _TRIANGLE), ("gone", _PATH), ("grown", _PATH)) for e in es]), "g")
AFTER = of_suppliers(Fixture(_GRAPHS, [(g, *e) for g, es in (("cut", _PATH), ("same", _TRIANGLE), ("grown", _TRIANGLE)) for e in es]), "g")


# The connectivity of a triangle is 3, of a path of three 1, of two apart 0.
@query(BEFORE.answers("('cut', 3.0::DOUBLE, 1.0::DOUBLE), ('gone', 1.0, 0.0)", "g, before double, after double"))
def connectivity_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = lambda graphs: O.fiedler_split(graphs.frame(spark, sf_dir).withColumnRenamed("g", "component")).groupBy(F.col("component").alias("g")).agg(F.round(F.max("connectivity"), 6).alias("connectivity"))
    return O.connectivity_drops(measured(BEFORE), measured(AFTER))


@query(
    f"""WITH e AS {_EDGES}, d AS (SELECT node, count(*) AS arity FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT p_partkey AS node, coalesce(arity, 0)::BIGINT AS arity, 3 AS expected FROM part LEFT JOIN d ON node = p_partkey WHERE coalesce(arity, 0) <> 3"""
)
def degree_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.lit(3).alias("expected"))
    return O.degree_violations(_edges(spark, sf_dir), expected)


@query(
    """SELECT n_nationkey AS src, o_orderpriority AS dst, count(DISTINCT c_custkey)::BIGINT AS paths FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def rule_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation with orders of a priority."""
    has = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"))
    ordered = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"))
    return O.two_hop(has, ordered)


FACTS = Fixture("rel string, src string, dst string", [("parent", "a", "b"), ("parent", "b", "c"), ("parent", "b", "d"), ("parent", "c", "e")])
FACTS = of_suppliers(FACTS, "src", "dst")


@query(f"SELECT x.src, y.dst, count(*)::BIGINT AS paths FROM {FACTS.sql} x JOIN {FACTS.sql} y ON x.dst = y.src GROUP BY 1, 2")
def rule_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = FACTS.frame(spark, sf_dir)
    return O.two_hop(parent, parent)


CELLS = Fixture("i int, j int, w double", [(0, 1, 0.5), (1, 2, -1.25), (1, 0, 2.0), (2, 2, 0.75), (4, 5, 99.0), (5, 5, 1.0), (7, 0, 3.0)])


#: A block of the matrix for each supplier.
BLOCKS = of_suppliers(CELLS, "i", "j")


@query(f"SELECT a.i, b.j, round(1 / (1 + exp(-greatest(-30, least(30, sum(a.w * b.w))))), 9) AS value FROM {BLOCKS.sql} a JOIN {BLOCKS.sql} b ON a.j = b.i GROUP BY 1, 2")
def sigmoid_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = BLOCKS.frame(spark, sf_dir)
    return O.sigmoid_product(cells, cells).withColumn("value", F.round("value", 9))


LOSS = Fixture("i int, j int, w double", [(0, 2, 0.5), (0, 0, -2.0), (2, 2, 1.5), (7, 1, 0.25), (3, 3, 9.0)])
LOSS = of_suppliers(LOSS, "i", "j")
_Y = f"SELECT a.i, b.j, 1 / (1 + exp(-greatest(-30, least(30, sum(a.w * b.w))))) AS y FROM {BLOCKS.sql} a JOIN {BLOCKS.sql} b ON a.j = b.i GROUP BY 1, 2"


@query(
    f"""WITH y AS ({_Y}), g AS (SELECT i, j, w * y * (1 - y) AS g FROM {LOSS.sql} JOIN y USING (i, j))
SELECT 'first' AS matrix, g.i, b.i AS j, round(sum(g * b.w), 9) AS w FROM g JOIN {BLOCKS.sql} b ON b.j = g.j GROUP BY 2, 3
UNION ALL SELECT 'second', a.j, g.j, round(sum(g * a.w), 9) FROM g JOIN {BLOCKS.sql} a ON a.i = g.i GROUP BY 2, 3"""
)
def sigmoid_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = BLOCKS.frame(spark, sf_dir)
    return O.sigmoid_gradients(cells, cells, O.sigmoid_product(cells, cells), LOSS.frame(spark, sf_dir)).withColumn("w", F.round("w", 9))


@query("SELECT CASE WHEN l_linenumber = 4 THEN 5 ELSE l_linenumber END AS i, l_quantity::INT % 9 AS j, round(sum(l_tax), 6) AS w FROM lineitem WHERE l_linenumber < 6 AND l_quantity::INT % 9 < 6 GROUP BY 1, 2")
def fault_rerouting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes by line number and quantity as cells; those out of bounds are left out, and row 4 moves on."""
    cells = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("i"), (F.col("l_quantity").cast("int") % 9).alias("j"), F.col("l_tax").alias("w"))
    return O.rerouted(O.in_arena(cells, 6), 4, 6).withColumn("w", F.round("w", 6))


SPLITS = Fixture("component int, src int, dst int", [(1, 0, 1), (1, 1, 2), (1, 0, 2), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 3, 5), (2, 10, 11)])
SPLITS = of_suppliers(SPLITS, "component")


@query(SPLITS.answers("(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 1), (1, 5, 1), (2, 10, 0), (2, 11, 1)", "component int, node int, side int"))
def fiedler_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles with a bridge part at the bridge."""
    return O.fiedler_split(SPLITS.frame(spark, sf_dir)).select("component", "node", "side")


@query(SPLITS.answers("(1, 0.438447::DOUBLE), (2, 2.0)", "component int, connectivity double"))
def algebraic_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fiedler_split(SPLITS.frame(spark, sf_dir)).groupBy("component").agg(F.round(F.max("connectivity"), 6).alias("connectivity"))


WAVES = Fixture(
    "g long, matrix string, i int, j int, w double",
    [(1, "U", 0, 1, 0.5), (1, "U", 1, 2, 0.5), (2, "U", 0, 0, 0.5), (3, "U", 0, 1, 2.0), (3, "M", 1, 2, 3.0), (3, "U", 2, 2, 0.5), (3, "M", 2, 2, 1.0)],
)
WAVES = of_suppliers(WAVES, "g")


@query(WAVES.answers("(1::BIGINT, 0::BIGINT, 1::BIGINT, 0.5::DOUBLE), (1, 1, 2, 0.5), (1, 0, 2, 0.25), (2, 0, 0, 1.0), (3, 0, 1, 2.0), (3, 0, 2, 6.0), (3, 2, 2, 1.0)", "g long, i long, j long, w double"))
def execution_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nilpotent matrix gives U + U^2; a loop of weight a half gives 1; a routing matrix comes between."""
    return O.execution_wave(WAVES.frame(spark, sf_dir), 3).withColumn("w", F.round("w", 9))


SLOPES = Fixture("g long, matrix string, i int, j int, w double", [(1, "U", 0, 0, 0.5), (1, "G", 0, 0, 1.0)])
SLOPES = of_suppliers(SLOPES, "g")


@query(SLOPES.answers("(1::BIGINT, 0::BIGINT, 0::BIGINT, 4.0::DOUBLE)", "g long, i long, j long, w double"))
def wave_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u / (1 - u) has the slope 1 / (1 - u)^2."""
    return O.wave_gradient(SLOPES.frame(spark, sf_dir), 1).withColumn("w", F.round("w", 9))


CLAMPS = Fixture("g long, matrix string, i int, j int, w double", [(1, "U", 0, 0, 2.0), (1, "U", 1, 1, -0.5)])
CLAMPS = of_suppliers(CLAMPS, "g")


@query(CLAMPS.answers("(1::BIGINT, 0::BIGINT, 0::BIGINT, 1.4::DOUBLE), (1, 1, 1, -0.35)", "g long, i long, j long, w double"))
def spectral_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues 2 and a half count as 0.9 and 0.5."""
    return O.spectral_clamp(CLAMPS.frame(spark, sf_dir), 2, 0.1).withColumn("w", F.round("w", 9))


RINGS = Fixture("src string, dst string", [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("d", "d"), ("e", "a")])


RINGS = of_suppliers(RINGS, "src", "dst")


@query("SELECT array_to_string(list_transform(string_split(cycle, ','), lambda x: x || '-' || s_suppkey), ',') AS cycle FROM supplier, (VALUES ('a,b'), ('a,b,c'), ('d')) t(cycle)")
def simple_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cycles(RINGS.frame(spark, sf_dir), 5).select(F.array_join("cycle", ",").alias("cycle"))


@query("SELECT v.wave, string_agg(v.name || '-' || s_suppkey, ',' ORDER BY v.name || '-' || s_suppkey) AS names FROM supplier, (VALUES (0::BIGINT, 'e'), (1, 'a'), (1, 'b'), (1, 'c'), (1, 'd')) v(wave, name) GROUP BY 1")
def wave_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cycle holds comes last, sorted."""
    waves = C.waves(RINGS.frame(spark, sf_dir)).groupBy(F.col("wave").cast("long").alias("wave"))
    return waves.agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("names"))


# Orders point at their parts; numbers that are an order's and a part's make ways longer than one, and cycles.
_ITEMS = """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey::BIGINT AS src, l_partkey::BIGINT AS dst FROM lineitem),
i AS (SELECT src, dst FROM e WHERE src IN (SELECT dst FROM e) AND dst IN (SELECT src FROM e)),
c AS (SELECT src, dst FROM i UNION SELECT c.src, i.dst FROM c JOIN i ON i.src = c.dst),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"))


@query(_ITEMS + "SELECT node, coalesce(least(node, m), node) AS component FROM n LEFT JOIN (SELECT a.src, min(a.dst) AS m FROM c a JOIN c b ON b.src = a.dst AND b.dst = a.src GROUP BY 1) ON src = node")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.strong_components(_items(spark, sf_dir))


@query(
    _ITEMS
    + """, s AS (SELECT DISTINCT src AS node FROM c WHERE src = dst UNION SELECT e.dst FROM s JOIN e ON e.src = s.node),
f AS (SELECT src, dst FROM e WHERE dst NOT IN (SELECT node FROM s)),
r AS (SELECT node, 0 AS wave FROM n WHERE node NOT IN (SELECT node FROM s) UNION SELECT f.dst, r.wave + 1 FROM r JOIN f ON f.src = r.node),
w AS (SELECT node, max(wave)::INT AS wave FROM r GROUP BY 1)
SELECT node, wave FROM w UNION ALL SELECT node, (SELECT coalesce(max(wave), -1) + 1 FROM w)::INT FROM s"""
)
def waves_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of orders and parts; what hangs on a cycle comes last."""
    return C.waves(_items(spark, sf_dir))


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey::BIGINT AS src, l_partkey::BIGINT AS dst FROM lineitem)
SELECT a.src::VARCHAR AS cycle FROM e a WHERE a.src = a.dst
UNION ALL SELECT a.src || ',' || a.dst FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || ',' || a.dst || ',' || b.dst FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst"""
)
def cycles_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of three or fewer."""
    return C.cycles(_items(spark, sf_dir), 3).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query()
def spectral_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, side, connectivity) of customers (as negative numbers) and the suppliers that their orders name; no SQL has eigenvectors."""
    items, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    rows = items.count()
    parts = tasks_for(spark, rows)
    named = spread_join(items.select("l_orderkey", "l_suppkey"), orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", [], parts=parts)
    edges = named.select(F.lit(0).alias("component"), (-F.col("o_custkey").cast("long")).alias("src"), F.col("l_suppkey").cast("long").alias("dst"))
    return C.spectral_halves(edges, tolerance=1e-3, rows=rows).select("node", "side", F.round("connectivity", 3).alias("connectivity"), (F.col("residual") < 1).alias("settled"))


@query()
def svd_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of the last 32 vectors, of which every third stands for its number's hash."""
    vector = F.when(F.col("vec_id") % 3 > 0, F.col("embedding"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", vector.alias("v"), (F.col("vec_id") % 2).alias("gain"), F.col("vec_id").cast("string").alias("text"))
    return O.projector(rows, "vec_id", "v", "gain", "text", 64)




# Part p requires its half and its third where they are whole, and every tenth something that isn't there.
_NEEDS = """(SELECT 'p' || p_partkey AS name, unnest(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'p' || (p_partkey // 2) END, CASE WHEN p_partkey % 3 = 0 THEN 'p' || (p_partkey // 3) END, CASE WHEN p_partkey % 10 = 0 THEN 'x' || p_partkey END], lambda r: r IS NOT NULL)) AS r FROM part WHERE p_partkey > 0)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("long").cast("string"))
    needs = F.array(F.when(p % 2 == 0, name("p", p / 2)), F.when(p % 3 == 0, name("p", p / 3)), F.when(p % 10 == 0, name("x", p)))
    return load(spark, sf_dir, "part").where("p_partkey > 0").select(name("p", p).alias("name"), F.array_compact(needs).alias("requires"))


@query(f"SELECT name, r AS missing FROM {_NEEDS} WHERE r NOT IN (SELECT 'p' || p_partkey FROM part)")
def unknown_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.unknown_requirements(_targets(spark, sf_dir))


@query(
    f"""WITH RECURSIVE e AS (SELECT name, r FROM {_NEEDS} WHERE r IN (SELECT 'p' || p_partkey FROM part)),
d AS (SELECT r AS name, 0 AS stage FROM e UNION SELECT e.name, d.stage + 1 FROM d JOIN e ON e.r = d.name)
SELECT name, max(stage)::INT AS stage FROM d GROUP BY 1"""
)
def build_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage in which a target can be built."""
    rows = _targets(spark, sf_dir)
    known = rows.select("name", F.explode("requires").alias("r")).join(rows.select(F.col("name").alias("r")), "r")
    return O.levels(known.select(F.col("r").alias("src"), F.col("name").alias("dst"))).select(F.col("node").alias("name"), F.col("level").alias("stage"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey - 1 WHEN n_nationkey < (SELECT max(n_nationkey) FROM nation) THEN n_nationkey + 1 ELSE n_nationkey END::BIGINT AS place FROM nation")
def build_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as targets, the even ones requiring the next; a configuration's order is the driver's work."""
    rows = load(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    names = {r.n_nationkey: r.n_name for r in rows}
    order = O.kahn_order([(n, [names[k + 1]] if k % 2 == 0 and k + 1 in names else ["gone"]) for k, n in names.items()])
    return spark.createDataFrame([(n, k) for k, n in enumerate(order)], "name string, place long")


@query("SELECT c_nationkey AS node, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS depends FROM customer GROUP BY 1")
def dependency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct dependencies of each node."""
    rows = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node"))
    return rows.agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("depends"))


@query(
    "WITH d AS (SELECT DISTINCT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b FROM supplier, customer WHERE s_suppkey % 25 = c_custkey % 25 AND s_nationkey <> c_nationkey), n AS (SELECT count(DISTINCT x) AS n FROM (SELECT a AS x FROM d UNION ALL SELECT b FROM d)), e AS (SELECT count(*) AS e FROM d) SELECT n::BIGINT AS nodes, e::BIGINT AS edges, round(2.0 * e / (n * (n - 1)), 6) AS density, round(2.0 * e / n, 6) AS average_degree, n > 20 AS exceeds_threshold FROM n, e"
)
def graph_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 25).alias("k"), "s_nationkey").distinct()
    c = load(spark, sf_dir, "customer").select((F.col("c_custkey") % 25).alias("k"), "c_nationkey").distinct()
    edges = s.join(c, "k").select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
    return O.complexity(edges, 20).withColumns({"density": F.round("density", 6), "average_degree": F.round("average_degree", 6)})
