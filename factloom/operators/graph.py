"""Levels, closure, cycles, degrees and rules over edge tables.

Loops store each step by a reliable checkpoint, so a lost executor costs one step; every step
is a join on the part of the graph that is still open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept


class CycleError(ValueError):
    pass


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph (src, dst): the length of the longest way to a node."""
    edges = kept(edges.select("src", "dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    front = kept(nodes.join(edges.hint("merge"), nodes["node"] == edges["dst"], "left_anti"))
    left, done, level = edges, [], 0
    while not front.isEmpty():
        done.append(front.withColumn("level", F.lit(level)))
        rest = kept(left.join(front.hint("merge"), left["src"] == front["node"], "left_anti"))
        # Next are the targets of what goes, if nothing left points at them.
        gone = left.join(front.hint("merge"), left["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        front = kept(gone.join(rest.hint("merge"), gone["node"] == rest["dst"], "left_anti"))
        left, level = rest, level + 1
    if not left.isEmpty():
        raise CycleError("the graph has a cycle")
    out = done[0] if done else nodes.withColumn("level", F.lit(0))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def repaired_levels(before: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(node, level, touched) of the changed graph ``edges`` from the levels (node, level) that it had ``before``.

    Work starts at the targets of changed edges and goes on to the successors of nodes whose level
    turns out another; no other node is looked at. ``touched`` tells which were. Each step
    stores the levels that changed so far, not the whole.
    """
    # Read in every step.
    edges = kept(edges.select("src", "dst").distinct())
    added, removed = kept(added.select("src", "dst")), removed.select("src", "dst")
    both = added.select("src", "dst").unionByName(removed.select("src", "dst"))
    fresh = added.select(F.col("src").alias("node")).unionByName(added.select(F.col("dst").alias("node"))).distinct()
    new = fresh.join(before, "node", "left_anti").select("node", F.lit(0).alias("level"))
    old = kept(before.select("node", "level").unionByName(new))
    open_ = kept(both.select(F.col("dst").alias("node")).distinct())
    seen, changed = open_, None
    # A new edge adds the longest way there was, and itself, at most; only a cycle adds more.
    top = old.agg(F.max("level")).first()[0] or 0
    most = (top + 1) * (added.count() + 1)
    while not open_.isEmpty():
        now = old if changed is None else old.join(changed.select("node", F.col("level").alias("_l")).hint("merge"), "node", "left").select("node", F.coalesce("_l", "level").alias("level"))
        into = edges.join(open_.select(F.col("node").alias("dst")), "dst", "left_semi")
        above = into.join(now.select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("fit"))
        fit = open_.join(now, "node").join(above, "node", "left").select("node", "level", F.coalesce("fit", F.lit(0)).alias("fit"))
        moved = kept(fit.where("fit <> level").select("node", F.col("fit").cast("int").alias("level")))
        if not moved.where(F.col("level") > most).isEmpty():
            raise CycleError("the changed graph has a cycle")
        changed = moved if changed is None else kept(changed.join(moved, "node", "left_anti").unionByName(moved))
        open_ = kept(edges.join(moved.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
        seen = kept(seen.unionByName(open_).distinct())
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    out = nodes.join(old, "node").join(seen.withColumn("touched", F.lit(True)), "node", "left")
    if changed is not None:
        out = out.join(changed.select("node", F.col("level").alias("_l")), "node", "left").withColumn("level", F.coalesce("_l", "level"))
    return out.select("node", "level", F.coalesce("touched", F.lit(False)).alias("touched"))


def has_cycle(edges: DataFrame) -> bool:
    try:
        levels(edges)
    except CycleError:
        return True
    return False


def cyclic_part(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that are left when nodes without a way in or without a way out are peeled off, again and again."""
    left = kept(edges.select("src", "dst").distinct())
    count = left.count()
    while count:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = kept(inner.select("src", "dst"))
        now = left.count()
        if now == count:
            break
        count = now
    return left


def one_cycle(edges: DataFrame) -> DataFrame:
    """(node, place) of one cycle of edges (src, dst), from its least node on; empty for an acyclic graph.

    In the cyclic part each node points at its least successor; the pointers are doubled until
    all lie on cycles, and the cycle of the least node is walked.
    """
    left = cyclic_part(edges)
    pointer = kept(left.groupBy("src").agg(F.min("dst").alias("dst")))
    ahead, steps, nodes = pointer, 1, pointer.count()
    while steps < nodes:
        ahead, steps = kept(ahead.alias("a").join(ahead.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))), steps * 2
    round_ = pointer.join(ahead.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    start = round_.agg(F.min("src").alias("node")).where("node is not null")
    return reachable(round_, start).select("node", F.col("depth").alias("place"))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): the seeds (node) and all that follows from them, with the least depth."""
    front = kept(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    found, depth = front, 0
    while True:
        depth += 1
        step = edges.join(front.hint("merge"), edges["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        front = kept(step.join(found.hint("merge"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found
        # Each depth is stored once.
        found = found.unionByName(front)


def invalidated(cache: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of ``cache`` (key, fingerprint, ...) that stay when keys have new fingerprints.

    ``changed`` is (key, fingerprint). Only those that differ evict, with all that depends on them.
    """
    new = changed.select(F.col("key").alias("node"), F.col("fingerprint").alias("new"))
    differs = cache.join(new, cache["key"] == new["node"]).where("fingerprint <> new").select("node")
    gone = reachable(edges, differs).select(F.col("node").alias("key"))
    return cache.join(gone, "key", "left_anti")


def degree_violations(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """(node, arity, expected) where a node's edges, in and out, are not as many as expected."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    arity = ends.groupBy("node").agg(F.count("*").alias("arity"))
    both = expected.join(arity, "node", "left").withColumn("arity", F.coalesce("arity", F.lit(0).cast("long")))
    return both.where("arity <> expected").select("node", "arity", "expected")


def type_violations(wires: DataFrame, ports: DataFrame) -> DataFrame:
    """(src, src_port, dst, dst_port, expected, actual) of wires between ports (node, port, type) of different types; null fits all."""
    a = ports.select(F.col("node").alias("src"), F.col("port").alias("src_port"), F.col("type").alias("expected"))
    b = ports.select(F.col("node").alias("dst"), F.col("port").alias("dst_port"), F.col("type").alias("actual"))
    return wires.join(a, ["src", "src_port"]).join(b, ["dst", "dst_port"]).where("expected <> actual").select("src", "src_port", "dst", "dst_port", "expected", "actual")


def connectivity_drops(before: DataFrame, after: DataFrame, threshold: float = 0.15) -> DataFrame:
    """(g, before, after) of graphs (g, connectivity) whose connectivity fell by more than the threshold.

    A graph that had none must have the threshold itself; one that is gone has 0.
    """
    both = before.select("g", F.col("connectivity").alias("before")).join(after.select("g", F.col("connectivity").alias("after")), "g", "left").na.fill(0.0, ["after"])
    least = F.when(F.col("before") > 0, (1 - threshold) * F.col("before")).otherwise(F.lit(threshold))
    return both.where(F.col("after") < least)


def crossing_edges(edges: DataFrame, level: DataFrame) -> DataFrame:
    """(src, dst, from_level, to_level) of edges between different levels."""
    a = level.select(F.col("node").alias("src"), F.col("level").alias("from_level"))
    b = level.select(F.col("node").alias("dst"), F.col("level").alias("to_level"))
    return edges.join(a, "src").join(b, "dst").where("from_level <> to_level").select("src", "dst", "from_level", "to_level")


def complexity(edges: DataFrame, threshold: int = 40) -> DataFrame:
    """(nodes, edges, density, average_degree, exceeds_threshold) of distinct undirected edges (src, dst), loops left out."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    n, e = F.col("nodes"), F.col("edges")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x")).agg(F.countDistinct("x").alias("nodes"))
    both = ends.crossJoin(pairs.agg(F.count("*").alias("edges")))  # one row each
    density = F.when(n > 1, 2.0 * e / (n * (n - 1))).otherwise(0.0)
    return both.select("nodes", "edges", density.alias("density"), F.when(n > 0, 2.0 * e / n).otherwise(0.0).alias("average_degree"), (n > threshold).alias("exceeds_threshold"))


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst, paths): A(x, y) and B(y, z) give C(x, z) with the number of y."""
    a = first.select("src", F.col("dst").alias("mid")).distinct()
    b = second.select(F.col("src").alias("mid"), "dst").distinct()
    return a.join(b, "mid").groupBy("src", "dst").agg(F.count("*").alias("paths"))


def sigmoid_product(first: DataFrame, second: DataFrame, clip: float = 30.0) -> DataFrame:
    """(i, j, value): the sigmoid of the product of two sparse matrices (i, j, w)."""
    a = first.select("i", F.col("j").alias("k"), F.col("w").alias("wa"))
    b = second.select(F.col("i").alias("k"), "j", F.col("w").alias("wb"))
    x = F.sum(F.col("wa") * F.col("wb"))
    sums = a.join(b, "k").groupBy("i", "j").agg(x.alias("x"))
    return sums.select("i", "j", (1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("x")))))).alias("value"))


def sigmoid_gradients(first: DataFrame, second: DataFrame, value: DataFrame, loss: DataFrame) -> DataFrame:
    """(matrix, i, j, w): derivatives by the ``first`` and ``second`` factor, for ``loss`` (i, j, w) by the product's ``value``."""
    y = F.col("value")
    g = loss.join(value, ["i", "j"]).select("i", "j", (F.col("w") * y * (1 - y)).alias("g"))
    by_first = g.join(second.select(F.col("i").alias("k"), "j", "w"), "j").groupBy("i", F.col("k").alias("j")).agg(F.sum(F.col("g") * F.col("w")).alias("w"))
    by_second = g.join(first.select("i", F.col("j").alias("k"), "w"), "i").groupBy(F.col("k").alias("i"), "j").agg(F.sum(F.col("g") * F.col("w")).alias("w"))
    return by_first.select(F.lit("first").alias("matrix"), "i", "j", "w").unionByName(by_second.select(F.lit("second").alias("matrix"), "i", "j", "w"))


def in_arena(cells: DataFrame, n: int) -> DataFrame:
    """Cells (i, j, w) within an n by n arena."""
    return cells.where((F.col("i") >= 0) & (F.col("i") < n) & (F.col("j") >= 0) & (F.col("j") < n))


def rerouted(cells: DataFrame, fault: int, n: int) -> DataFrame:
    """Row ``fault`` moves to the next slot, where it is added to what is there."""
    to = F.when(F.col("i") == fault, (fault + 1) % n).otherwise(F.col("i"))
    return cells.withColumn("i", to.cast("int")).groupBy("i", "j").agg(F.sum("w").alias("w"))


def _components(edges: DataFrame) -> DataFrame:
    """(node, component): least node that is reached, for undirected edges of bounded graphs."""
    both = kept(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = kept(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        least = both.join(now, both["dst"] == now["node"]).groupBy("src").agg(F.min("component").alias("m")).withColumnRenamed("src", "node")
        after = kept(now.join(least, "node").select("node", F.least("component", "m").alias("component")))
        # Follow the label's own label, which halves the way.
        up = after.select(F.col("node").alias("component"), F.col("component").alias("top"))
        after = kept(after.join(up, "component").select("node", F.least("component", "top").alias("component")))
        if after.exceptAll(now).isEmpty():
            return after
        now = after


def with_component(edges: DataFrame) -> DataFrame:
    own = _components(edges).withColumnRenamed("node", "src")
    return edges.join(own, "src")


def _equal(keys: pd.Series, value) -> np.ndarray:
    """Null is equal to null."""
    return (keys.isna() if pd.isna(value) else keys == value).to_numpy(bool)


def _in_groups(rows: DataFrame, key: str, work, ddl: str) -> DataFrame:
    """``work`` on whole groups of a key, many groups at a time: a call for each would cost more than its small matrix.

    ``work`` takes rows sorted by the key, with all rows of each key that they hold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            # The last group may go on in the next batch.
            same = _equal(batch[key], batch[key].iloc[-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if held and (cut or not _equal(held[-1][key].iloc[-1:], batch[key].iloc[0])[0]):
                yield work(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held = []
            elif cut:
                yield work(batch.iloc[:cut].reset_index(drop=True))
            held.append(batch.iloc[cut:])
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(run, ddl)


def _numbered(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys the place of each row's group, and the rows at which groups begin."""
    x, none = keys.to_numpy(), keys.isna().to_numpy()
    first = np.concatenate([[True], (x[1:] != x[:-1]) & ~(none[1:] & none[:-1])])
    return np.cumsum(first) - 1, np.flatnonzero(first)


#: Cells of the matrices that are worked on at once.
STACK = 4_000_000


def fiedler_split(edges: DataFrame) -> DataFrame:
    """(component, node, side, connectivity) of (component, src, dst): halves by the Fiedler vector.

    A component is one dense matrix, so it has to be of bounded size. The sign of the vector
    is free: the side of the least node is 0. Where the signs leave one side empty, the
    median parts.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        group, first = _numbered(pdf["component"])
        ends = pd.concat([pdf["src"], pdf["dst"]], ignore_index=True)
        whole = pd.DataFrame({"g": np.concatenate([group, group]), "node": ends})
        nodes = whole.drop_duplicates().sort_values(["g", "node"], ignore_index=True)
        size = np.bincount(nodes["g"], minlength=len(first))
        start = np.concatenate([[0], np.cumsum(size)])
        nodes["at"] = np.arange(len(nodes)) - start[nodes["g"]]
        at = whole.merge(nodes, on=["g", "node"], how="left")["at"].to_numpy()
        src, dst = at[: len(pdf)], at[len(pdf) :]
        side, connectivity = np.zeros(len(nodes), "i4"), np.zeros(len(nodes))
        # Graphs of one size are decomposed together.
        for n in np.unique(size):
            if n < 2:
                continue
            some = np.flatnonzero(size == n)
            for k in range(0, len(some), max(1, STACK // int(n * n))):
                part = some[k : k + max(1, STACK // int(n * n))]
                place = np.full(len(first), -1)
                place[part] = np.arange(len(part))
                own = place[group] >= 0
                p, s, d = place[group[own]], src[own], dst[own]
                a = np.zeros((len(part), n, n))
                a[p, s, d] = a[p, d, s] = 1.0
                a[:, np.arange(n), np.arange(n)] = 0.0
                degrees = np.zeros_like(a)
                degrees[:, np.arange(n), np.arange(n)] = a.sum(2)
                values, vectors = np.linalg.eigh(degrees - a)
                v = vectors[:, :, 1]
                up = v >= 0
                flat = up.all(1) | ~up.any(1)
                up[flat] = v[flat] >= np.median(v[flat], axis=1, keepdims=True) if flat.any() else up[flat]
                rows = start[part][:, None] + np.arange(n)
                side[rows] = up != up[:, :1]
                connectivity[rows] = values[:, 1:2]
        return pd.DataFrame({"component": pdf["component"].to_numpy()[first][nodes["g"]], "node": nodes["node"], "side": side, "connectivity": connectivity})

    kind = dict(edges.dtypes)["src"]
    return _in_groups(edges.select("component", "src", "dst"), "component", split, f"component {dict(edges.dtypes)['component']}, node {kind}, side int, connectivity double")


_CELLS = "g long, i long, j long, w double"


def _on_matrices(cells: DataFrame, n: int, solve) -> DataFrame:
    """(g, i, j, w) of what ``solve`` makes of each group's U, M (the identity where it is missing) and G, stacked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group, first = _numbered(pdf["g"])
        out = []
        many = max(1, STACK // (n * n))
        for k in range(0, len(first), many):
            count = min(many, len(first) - k)
            here = (group >= k) & (group < k + count)
            g, rows = group[here] - k, pdf[here]
            dense = {name: np.zeros((count, n, n)) for name in ("U", "M", "G")}
            for name, x in dense.items():
                own = (rows["matrix"] == name).to_numpy()
                np.add.at(x, (g[own], rows["i"].to_numpy()[own], rows["j"].to_numpy()[own]), rows["w"].to_numpy()[own])
            none = np.ones(count, bool)
            none[g[(rows["matrix"] == "M").to_numpy()]] = False
            dense["M"][none] = np.eye(n)
            x = solve(dense["U"], dense["M"], dense["G"])
            at, i, j = np.nonzero(np.abs(x) > 1e-12)
            out.append(pd.DataFrame({"g": pdf["g"].to_numpy()[first[k + at]], "i": i, "j": j, "w": x[at, i, j]}))
        return pd.concat(out)

    return _in_groups(cells, "g", run, _CELLS)


def execution_wave(cells: DataFrame, n: int) -> DataFrame:
    """(g, i, j, w) of (I - U M)^-1 U for each group's n by n matrices of (g, matrix, i, j, w).

    ``matrix`` is U or M; a group without M has the identity. Bounded by n, as it is one task's.
    """
    return _on_matrices(cells, n, lambda u, m, _: np.linalg.solve(np.eye(n) - u @ m, u))


def wave_gradient(cells: DataFrame, n: int) -> DataFrame:
    """(g, i, j, w): derivative by U of a loss whose derivative by the wave is the matrix G."""

    def slope(u: np.ndarray, m: np.ndarray, out: np.ndarray) -> np.ndarray:
        inverse = np.linalg.inv(np.eye(n) - u @ m)
        turned = lambda x: x.transpose(0, 2, 1)
        return turned(inverse) @ out @ (np.eye(n) + turned(m) @ turned(inverse @ u))

    return _on_matrices(cells, n, slope)


def spectral_clamp(cells: DataFrame, n: int, parameter: float) -> DataFrame:
    """(g, i, j, w): U times the mean of its eigenvalues' sizes, each at most 1 - parameter."""
    return _on_matrices(cells, n, lambda u, m, _: u * np.clip(np.abs(np.linalg.eigvals(u)), 0.0, 1.0 - parameter).mean(1)[:, None, None])


def hashed_vector(text: str, size: int) -> np.ndarray:
    """A vector that a text stands for: normal numbers seeded by its hash."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")).standard_normal(size)


def projector(rows: DataFrame, order: str, vector: str, gain: str, canonical: str, size: int, last: int = 32, least: float = 0.5) -> DataFrame:
    """(i, j, value): the projector onto what the vectors with enough gain among the ``last`` rows span.

    A row without a vector has the one that its canonical text stands for; others are cut or
    filled up to ``size``. The identity, if there are fewer than three rows or none has the gain.
    At most ``last`` rows reach the one task that decomposes them.
    """
    recent = rows.select(F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"), F.col(gain).cast("double").alias("gain"), F.col(canonical).alias("text"))
    recent = recent.orderBy(F.desc("o")).limit(last).groupBy().agg(F.collect_list(F.struct("v", "gain", "text")).alias("rows"))  # so many

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own in batch["rows"]:
                p = np.eye(size)
                good = [r for r in own if r["gain"] is not None and r["gain"] > least] if len(own) >= 3 else []
                if good:
                    x = np.zeros((len(good), size))
                    for k, r in enumerate(good):
                        v = np.asarray(r["v"], "f8")[:size] if r["v"] is not None and len(r["v"]) else hashed_vector(r["text"] or "", size)
                        x[k, : len(v)] = v
                    _, s, vt = np.linalg.svd(x, full_matrices=False)
                    vt = vt[s > 1e-10 * max(s.max(), 1e-300)]
                    p = vt.T @ vt
                i, j = np.indices(p.shape)
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": p.ravel()})

    return recent.mapInPandas(project, "i long, j long, value double")


def unknown_requirements(targets: DataFrame) -> DataFrame:
    """(name, missing) of (name, requires): requirements that no target has."""
    wanted = targets.select("name", F.explode("requires").alias("missing")).distinct()
    return wanted.join(targets.select(F.col("name").alias("missing")), "missing", "left_anti").select("name", "missing")


def kahn_order(targets: list[tuple[str, list[str]]]) -> list[str]:
    """Names so that requirements come first, ties in the given order; driver-side, for configurations."""
    at = {name: k for k, (name, _) in enumerate(targets)}
    waiting = {name: set(requires) & set(at) for name, requires in targets}
    order: list[str] = []
    while waiting:
        ready = [n for n in waiting if not waiting[n]]
        if not ready:
            raise CycleError(", ".join(sorted(waiting)))
        name = min(ready, key=at.__getitem__)
        order.append(name)
        del waiting[name]
        for left in waiting.values():
            left.discard(name)
    return order
