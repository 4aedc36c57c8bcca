"""Strongly connected components, waves over graphs with cycles, and halves of large graphs.

Labels run along edges, the least one wins, and a label's own label is taken over in every
other step, which makes long ways short. Every step is stored and works on what is still open; nodes with
very many edges are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, tasks_for
from .skew import Dealt, hot_keys, spread_join


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _least_before(edges: Dealt, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node from which there is a way to a node, itself included; ``edges`` are dealt by ``src``.

    Only labels that are new since a node last sent its own go along its edges.
    """
    now = sending = nodes.select("node", F.col("node").alias("label"))
    k = 0
    while True:
        sent = edges.join(sending.select(F.col("node").alias("src"), "label"))
        none = F.lit(None).cast(dict(nodes.dtypes)["node"])
        got = sent.select(F.col("dst").alias("node"), "label", none.alias("old"))
        after = now.select("node", "label", F.col("label").alias("old")).unionByName(got).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        after = kept(after)
        k += 1
        if k % 2 == 0:
            # What leads to a label's node leads here too. Labels of many nodes are hot keys.
            tops = after.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("top"))
            after = kept(spread_join(after, tops, "label", hot_keys(after, "label"), "left").select("node", F.least("label", "top").alias("label"), "old"))
        sending = after.where("label < old")
        if sending.isEmpty():
            return after.select("node", "label")
        now = after


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when those of nodes without a way in or out go, as long as that takes a tenth of them."""
    left = kept(edges)
    count = left.count()
    while count:
        sources, targets = left.select("src").distinct(), left.select(F.col("dst").alias("src")).distinct()
        inner = left.join(targets.hint("merge"), "src", "left_semi").join(sources.withColumnRenamed("src", "dst").hint("merge"), "dst", "left_semi")
        left = kept(inner.select("src", "dst"))
        now = left.count()
        if now > 0.9 * count:
            break
        count = now
    return left


def _entered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, into, out) of all nodes and whether edges come and go; the distinct edges (src, dst) whose source has one coming in.

    Only those lie on cycles, or follow from one.
    """
    edges = edges.where("src is not null and dst is not null").select("src", "dst")
    yes, no = F.lit(True), F.lit(False)
    ends = F.array(F.struct(F.col("src").alias("node"), no.alias("into"), yes.alias("out")), F.struct(F.col("dst").alias("node"), yes.alias("into"), no.alias("out")))
    nodes = kept(edges.select(F.inline(ends)).groupBy("node").agg(F.max("into").alias("into"), F.max("out").alias("out")))
    inner = nodes.where("into and out").select(F.col("node").alias("src"))
    return nodes, kept(edges.join(inner.hint("merge"), "src", "left_semi").distinct())


def _coloured(nodes: DataFrame, deep: DataFrame) -> DataFrame:
    """(node, component) of what rounds of colours find, from ``_entered``; all components of several nodes are in it."""
    left = deep.where("src <> dst").join(nodes.where("out").select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")
    found = nodes.select("node", F.col("node").alias("component")).where(F.lit(False))
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            return found
        open_ = kept(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
        parts = tasks_for(left.sparkSession, left.count())
        ways = Dealt(left, "src", parts)
        colour = _least_before(ways, open_)
        here = colour.select(F.col("node").alias("src"), F.col("label").alias("a"))
        there = colour.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        own = spread_join(ways.join(here), there, "dst", hot_keys(left, "dst"))
        own = kept(own.where("a = b").select("src", "dst"))
        ways.done()
        # The least node of a colour is its own; who leads to it has it as the least node ahead.
        ways = Dealt(_reversed(own), "src", parts)
        back = _least_before(ways, open_)
        ways.done()
        done = kept(colour.join(back.withColumnRenamed("label", "ahead").hint("merge"), "node").where("label = ahead").select("node", F.col("label").alias("component")))
        found = found.unionByName(done)
        gone = done.select(F.col("node").alias("src"))
        left = own.join(gone.hint("merge"), "src", "left_anti").join(gone.withColumnRenamed("src", "dst").hint("merge"), "dst", "left_anti").select("src", "dst")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of a directed graph (src, dst): the least node of those that lead to each other.

    Nodes are coloured by the least node that leads to them. Of a colour, those from which there
    is a way back to its node are a component; edges between colours are in none. The rest is
    coloured again. Nodes that no such round takes are components of their own.
    """
    nodes, deep = _entered(edges)
    found = _coloured(nodes, deep)
    return nodes.select("node").join(found.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def inside(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges (src, dst, component) whose ends are in one component."""
    a = components.select(F.col("node").alias("src"), "component")
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("to"))
    both = spread_join(spread_join(edges, a, "src", hot_keys(edges, "src")), b, "dst", hot_keys(edges, "dst"))
    return both.where(F.col("component") == F.col("to")).select("src", "dst", "component")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges (src, dst) between components, which have no cycle."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    both = spread_join(spread_join(edges, a, "src", hot_keys(edges, "src")), b, "dst", hot_keys(edges, "dst"))
    return both.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


#: Waves after which what waits for ever is told from what only waits long.
PEELED = 100


def _stuck(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of cycles and of what follows from them."""
    from .graph import reachable

    parts = _coloured(nodes, edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    several = parts.join(parts.groupBy("component").count().where("count > 1").hint("merge"), "component").select("node")
    return kept(reachable(edges, several.unionByName(loops)).select("node"))


def waves(edges: DataFrame) -> DataFrame:
    """(node, wave): nodes whose predecessors all are in earlier waves; what hangs on a cycle is the last wave.

    A wave takes its edges from what its targets wait for; who then waits for none is next. Only
    cycles and what follows from them wait for ever. After ``PEELED`` waves components tell
    which those are, so that further steps are on the rest alone.
    """
    nodes, deep = _entered(edges)
    spark, one = edges.sparkSession, F.lit(1).cast("long")
    waits = nodes.where("into").select("node", (one - 1).alias("n")).unionByName(deep.select(F.col("dst").alias("node"), one.alias("n")))
    waiting = kept(waits.groupBy("node").agg(F.sum("n").alias("n")))
    ways, stuck = Dealt(deep, "src", tasks_for(spark, deep.count())), None
    first = nodes.where("not into").select("node", F.lit(0).alias("wave"))
    done, wave = [first], 1
    while not (front := waiting.where("n = 0")).isEmpty():
        if wave == PEELED:
            left = kept(deep.join(waiting.select(F.col("node").alias("src")).hint("merge"), "src", "left_semi").select("src", "dst"))
            stuck = _stuck(nodes, left)
            waiting = kept(waiting.join(stuck.hint("merge"), "node", "left_anti"))
            left = kept(left.join(stuck.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti").select("src", "dst"))
            ways.done()
            ways, front = Dealt(left, "src", tasks_for(spark, left.count())), waiting.where("n = 0")
        done.append(front.select("node", F.lit(wave).alias("wave")))
        sent = ways.join(front.select(F.col("node").alias("src"))).select(F.col("dst").alias("node"), (-one).alias("n"))
        waiting = kept(waiting.where("n > 0").unionByName(sent).groupBy("node").agg(F.sum("n").alias("n")))
        wave += 1
    ways.done()
    # Where nothing is without a way in, the first wave is the last.
    last = F.lit(0 if wave == 1 and first.isEmpty() else wave).alias("wave")
    done.append((waiting.where("n > 0") if stuck is None else stuck).select("node", last))
    return reduce(DataFrame.unionByName, done)


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(cycle) of at most ``longest`` nodes, each once, from its least node on; ways grow inside components only."""
    nodes, deep = _entered(edges)
    several = inside(deep.where("src <> dst"), _coloured(nodes, deep)).select("src", "dst")
    e = kept(several.unionByName(deep.where("src = dst")))
    ways = e.where("src <= dst").select(F.array("src").alias("way"), F.col("dst").alias("at"))
    found = []
    for k in range(longest):
        found.append(ways.where(F.col("at") == F.get("way", F.lit(0))).select(F.col("way").alias("cycle")))
        if k == longest - 1:
            break
        # The least node begins, so later ones are larger.
        going = ways.where((F.col("at") > F.get("way", F.lit(0))) & ~F.array_contains("way", F.col("at")))
        grown = going.select(F.concat("way", F.array("at")).alias("way"), F.col("at").alias("src"))
        ways = kept(grown.join(e.hint("merge"), "src").select("way", F.col("dst").alias("at")))
        if ways.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


#: Names of the sums over a component that a step needs: of vectors, their products, and products with the matrix.
_VECTORS = ("x", "w", "p")
_PAIRS = [(a, b) for k, a in enumerate(_VECTORS) for b in _VECTORS[k:]]


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each component the combination of its three vectors with the least quotient, from sums over its nodes."""
    for batch in batches:
        n = batch["n"].to_numpy("f8")
        s = np.stack([batch[f"s_{a}"].to_numpy("f8") for a in _VECTORS], 1)
        out = np.zeros((len(batch), 4))
        theta = np.zeros(len(batch))
        for k in range(len(batch)):
            a, b = np.zeros((3, 3)), np.zeros((3, 3))
            for u, v in _PAIRS:
                i, j = _VECTORS.index(u), _VECTORS.index(v)
                a[i, j] = a[j, i] = batch[f"a_{u}{v}"].iloc[k]
                b[i, j] = b[j, i] = batch[f"b_{u}{v}"].iloc[k]
            # The constant vector, which the matrix sends to 0, is taken out of all three.
            b -= np.outer(s[k], s[k]) / n[k]
            size = np.sqrt(np.maximum(np.diag(b), 0.0))
            use = np.flatnonzero(size > 1e-150)
            if not len(use):
                continue
            scaled_b = b[np.ix_(use, use)] / np.outer(size[use], size[use])
            scaled_a = a[np.ix_(use, use)] / np.outer(size[use], size[use])
            values, vectors = np.linalg.eigh(scaled_b)
            keep = values > 1e-10
            root = vectors[:, keep] / np.sqrt(values[keep])
            low, turn = np.linalg.eigh(root.T @ scaled_a @ root)
            theta[k] = low[0]
            out[k, use] = (root @ turn[:, 0]) / size[use]
            out[k, 3] = -(out[k, :3] @ s[k]) / n[k]
        yield pd.DataFrame({"component": batch["component"], "theta": theta, **{f"k{j}": out[:, j] for j in range(4)}})


def fiedler_vectors(edges: DataFrame, tolerance: float = 1e-6, most: int = 100, rows: int | None = None) -> DataFrame:
    """(component, node, value, connectivity, residual) of undirected graphs (component, src, dst).

    The vector of the second-least eigenvalue of each component's Laplacian, by a preconditioned
    conjugate gradient on the quotient: a step multiplies one vector by the matrix (a join
    along the edges), and takes the best combination of the vector, its residual over the degrees
    and the last direction. ``residual`` is the length of L v - connectivity v for the vector v of
    length 1. Steps end when all residuals are under ``tolerance`` times the largest degree, or
    after ``most``. Work along the edges is dealt out by their number, which ``rows``, if given,
    is at least; a task holds no more of them when there are more.
    """
    spark = edges.sparkSession
    once = edges.where("src <> dst").select("component", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    # An edge is stored once, for both of its directions.
    once = kept(once.repartition(tasks_for(spark, edges.count() if rows is None else rows), "src", "dst").distinct())
    parts = tasks_for(spark, 2 * once.count())
    both = once.unionByName(once.select("component", F.col("dst").alias("src"), F.col("src").alias("dst")))
    hot, large = hot_keys(both, "src"), hot_keys(both, "component")
    start = (F.xxhash64("node") / F.lit(2.0**63)).alias("x")
    state = both.groupBy("component", F.col("src").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("deg")).withColumn("x", start)

    def times(vector: DataFrame, name: str, out: str) -> DataFrame:
        """(node, out): the Laplacian's product with a column of (node, deg, name)."""
        sent = spread_join(both.select("src", "dst"), vector.select(F.col("node").alias("src"), F.col(name).alias("_v")), "src", hot, parts=parts)
        sums = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("_v").alias("_s"))
        return vector.join(sums, "node").withColumn(out, F.col("deg") * F.col(name) - F.col("_s")).drop("_s")

    rest = F.col("lx") - F.col("theta") * F.col("x")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.pow(rest, 2)).alias("rest"), F.max("deg").alias("top"), *[F.sum(v).alias(f"s_{v}") for v in _VECTORS]]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"b_{a}{b}") for a, b in _PAIRS] + [F.sum(F.col(a) * F.col(f"l{b}")).alias(f"a_{a}{b}") for a, b in _PAIRS]
    along = F.col("k1") * F.col("w") + F.col("k2") * F.col("p")
    l_along = F.col("k1") * F.col("lw") + F.col("k2") * F.col("lp")
    ddl = f"component {dict(state.dtypes)['component']}, theta double, k0 double, k1 double, k2 double, k3 double"

    state = kept(times(state, "x", "lx").withColumns({"p": F.lit(0.0), "lp": F.lit(0.0)}))
    first = state.groupBy("component").agg((F.sum(F.col("x") * F.col("lx")) / F.sum(F.col("x") * F.col("x"))).alias("theta"))
    state = spread_join(state, first, "component", large)
    for k in range(most + 1):
        step = kept(times(state.withColumn("w", rest / F.col("deg")), "w", "lw"))
        about = kept(step.groupBy("component").agg(*sums))
        if k and (k == most or about.where(F.sqrt("rest") > tolerance * F.col("top")).isEmpty()):
            break
        mixed = spread_join(step.drop("theta"), about.mapInPandas(_combine, ddl), "component", large)
        state = mixed.select("component", "node", "deg", (F.col("k0") * F.col("x") + along + F.col("k3")).alias("x"), (F.col("k0") * F.col("lx") + l_along).alias("lx"), along.alias("p"), l_along.alias("lp"), "theta")
    left = about.select("component", F.sqrt("rest").alias("residual"))
    return spread_join(step, left, "component", large).select("component", "node", F.col("x").alias("value"), F.col("theta").alias("connectivity"), "residual")


def spectral_halves(edges: DataFrame, **options) -> DataFrame:
    """(component, node, side, connectivity, residual): sides by the sign of the Fiedler vector; that of the least node is 0.

    Where the signs leave one side empty, the median parts.
    """
    v = kept(fiedler_vectors(edges, **options))
    large = hot_keys(v, "component")
    about = v.groupBy("component").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.percentile_approx("value", 0.5, 10_000).alias("middle"), F.min_by("value", "node").alias("first"))
    cut = F.when((F.col("low") >= 0) | (F.col("high") < 0), F.col("middle")).otherwise(0.0)
    rows = spread_join(v, about.select("component", cut.alias("cut"), "first"), "component", large)
    side = ((F.col("value") >= F.col("cut")) != (F.col("first") >= F.col("cut"))).cast("int")
    return rows.select("component", "node", side.alias("side"), "connectivity", "residual")
