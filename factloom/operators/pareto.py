"""Pareto fronts, crowding, hypervolume and selections from them.

In order of their values a point is dominated only by earlier ones. With three objectives or
fewer that leaves a question of the last two: whether a staircase of earlier points lies under
a point, which a binary search answers. Over many partitions, points are dealt out by ranges of
that order; what a range has to know of earlier ones is their staircases. Where all objectives
but one have few combinations of values, it is a number for each of them.

A frontier is taken in a tree: each partition keeps its own non-dominated points, in half as
many partitions they are reduced again, and so on while that leaves fewer; ranges that stay
are held against each earlier range's staircase. Points with equal objectives don't dominate
each other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, ranges


def dominates(a: str, b: str, objectives: list[str], minimize: bool) -> Column:
    """Whether a is as good in all and better in one. Null is the worst when minimizing, 0 when maximizing."""
    worst = F.lit(float("inf") if minimize else 0.0)
    value = lambda side, o: F.coalesce(F.col(f"{side}.{o}").cast("double"), worst)
    pairs = [(value(a, o), value(b, o)) if minimize else (value(b, o), value(a, o)) for o in objectives]
    return reduce(lambda x, y: x & y, [p <= q for p, q in pairs]) & reduce(lambda x, y: x | y, [p < q for p, q in pairs])


class Stairs:
    """The minimal ones of points in the plane, by rising first and falling second value."""

    def __init__(self):
        self.x: list[float] = []
        self.y: list[float] = []

    def under(self, x: float, y: float) -> bool:
        """Whether a point is as small in both."""
        k = bisect_right(self.x, x)
        return k > 0 and self.y[k - 1] <= y

    def put(self, x: float, y: float) -> None:
        """Adds a point that none is under, and drops those that it is under."""
        first = last = bisect_left(self.x, x)
        while last < len(self.y) and self.y[last] >= y:
            last += 1
        self.x[first:last] = [x]
        self.y[first:last] = [y]


def _plane(x: np.ndarray) -> np.ndarray:
    """The last two of three objectives or fewer; what lacks is equal for all."""
    return np.concatenate([np.zeros((len(x), 2)), x[:, 1:]], axis=1)[:, -2:] if x.shape[1] < 3 else x[:, 1:]


def _front(x: np.ndarray, chunk: int = 512) -> np.ndarray:
    """The distinct points that none dominates, minimized, in order.

    More than three objectives are compared many at a time: points with the front so far, then
    with those of their own chunk.
    """
    values = np.unique(x, axis=0)
    if len(values) > chunk:
        # A few points that are good in all objectives take most others away at once.
        rank = sum(np.argsort(np.argsort(values[:, k], kind="stable"), kind="stable") for k in range(values.shape[1]))
        for good in values[np.argsort(rank, kind="stable")[:16]]:
            values = values[~((good <= values).all(1) & (good < values).any(1))]
    if x.shape[1] <= 3:
        stairs, keep = Stairs(), []
        for k, (a, b) in enumerate(_plane(values).tolist()):
            if not stairs.under(a, b):
                stairs.put(a, b)
                keep.append(k)
        return values[keep]
    front = np.zeros((0, x.shape[1]))
    for k in range(0, len(values), chunk):
        part = values[k : k + chunk]
        part = part[~_above(part, front)]
        under = (part[:, None] <= part).all(2)
        np.fill_diagonal(under, False)
        front = np.concatenate([front, part[~under.any(0)]])
    return front


def _above(points: np.ndarray, others: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Which points have an earlier one of ``others`` that is as small in all values but the first."""
    out = np.zeros(len(points), bool)
    if points.shape[1] <= 3:
        stairs = Stairs()
        for a, b in _plane(others).tolist():
            if not stairs.under(a, b):
                stairs.put(a, b)
        return np.array([stairs.under(a, b) for a, b in _plane(points).tolist()], bool)
    for k in range(0, len(points), chunk):
        part = points[k : k + chunk, 1:]
        for f in range(0, len(others), 4096):
            out[k : k + chunk] |= (others[f : f + 4096, None, 1:] <= part).all(2).any(0)
    return out


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    left: pd.DataFrame | None = None
    for batch in batches:
        whole = batch if left is None else pd.concat([left, batch], ignore_index=True)
        left = pd.DataFrame(_front(whole.to_numpy("f8")), columns=whole.columns)
    if left is not None:
        yield left


#: Points that one task compares with each other.
LAST = 50_000
#: Distinct points whose fronts one task finds, after those of all earlier ranges.
RANGE = 200_000
#: Combinations of values of all objectives but one up to which ranges are worked on at once.
CELLS = 256


def _objectives(objectives: list[str], minimize: bool) -> dict[str, Column]:
    """Values to minimize, by names of their own. Null and NaN are the worst when minimizing, 0 when maximizing."""
    worst = F.lit(float("inf") if minimize else 0.0)
    return {f"_o{k}": F.coalesce(F.nanvl(F.col(o).cast("double"), worst), worst) * (1 if minimize else -1) + 0.0 for k, o in enumerate(objectives)}


def _dominated(key: tuple, points: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    own, before = points.drop(columns=["i", "j"]), others.drop(columns=["i", "j"])
    if own.empty or before.empty:
        return own.iloc[:0]
    return own[_above(own.to_numpy("f8"), before.to_numpy("f8"))]


def _across(left: DataFrame, keys: list[str], count: int) -> DataFrame:
    """What of ``left``, too much for one task, no other row dominates.

    Rows go to ranges of their order; a range keeps its own front, which is then held against
    that of each earlier range, a task for each two.
    """
    ddl = ", ".join(f"{k} double" for k in keys)
    parts = -(-count // LAST)
    own = kept(ranges(left, parts, keys).mapInPandas(_local, ddl).withColumn("i", F.spark_partition_id()))
    late = own.where("i > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i") - 1)))
    early = own.where(F.col("i") < parts - 1).withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.col("j") + 1, F.lit(parts - 1))))
    gone = late.select("i", "j", *keys).groupBy("i", "j").cogroup(early.select("i", "j", *keys).groupBy("i", "j")).applyInPandas(_dominated, ddl)
    return own.drop("i").join(gone.distinct(), keys, "left_anti")


def frontier(points: DataFrame, objectives: list[str], minimize: bool = True) -> DataFrame:
    """The rows that no row dominates. Null is the worst when minimizing, 0 when maximizing."""
    values = _objectives(objectives, minimize)
    keys = list(values)
    ddl = ", ".join(f"{k} double" for k in keys)
    # Only values travel; rows that have the front's come back by a join.
    left = kept(points.select(*[v.alias(k) for k, v in values.items()]).mapInPandas(_local, ddl))
    count = left.count()
    while count:
        parts = -(-count // LAST)
        left = kept(left.repartition(parts).mapInPandas(_local, ddl))
        now = left.count()
        if parts == 1:
            break
        if now > 0.7 * count:
            left = _across(left, keys, now)
            break
        count = now
    same = reduce(lambda x, y: x & y, [values[k] == F.col(f"_f{k}") for k in keys])
    return points.join(left.select(*[F.col(k).alias(f"_f{k}") for k in keys]), same, "left_semi")


class _Levels:
    """Fronts of points that come in order. A point's dominators in a front imply one in each front before.

    Of each front the staircase of the last two of three objectives is held; of more objectives all points.
    """

    def __init__(self, dims: int):
        self._dims = dims
        self._fronts: list = []

    def __len__(self) -> int:
        return len(self._fronts)

    def under(self, front: int, point: list[float]) -> bool:
        if front >= len(self._fronts):
            return False
        held = self._fronts[front]
        if self._dims <= 3:
            return held.under(*point)
        return any((np.stack(held[f : f + 1024]) <= point).all(1).any() for f in range(0, len(held), 1024))

    def first_free(self, low: int, point: list[float]) -> int:
        """The first front from ``low`` on in which no point is under."""
        high = max(low, len(self._fronts))
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.under(middle, point) else (low, middle)
        return low

    def put(self, front: int, point: list[float]) -> None:
        while front >= len(self._fronts):
            self._fronts.append(Stairs() if self._dims <= 3 else [])
        held = self._fronts[front]
        if self._dims > 3:
            held.append(np.array(point))
        elif not held.under(*point):
            held.put(*point)


def _tails(x: np.ndarray) -> list[list[float]]:
    return (_plane(x) if x.shape[1] <= 3 else x[:, 1:]).tolist()


def _levels(x: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """The front of each of distinct points, minimized; ``base`` is the least that earlier ranges leave it."""
    level = np.zeros(len(x), "i8")
    base = np.zeros(len(x), "i8") if base is None else base
    held, tails = _Levels(x.shape[1]), _tails(x)
    for i in np.lexsort(x.T[::-1]).tolist():
        # From its base on, only points of this range can be under it.
        level[i] = held.first_free(int(base[i]), tails[i])
        held.put(int(level[i]), tails[i])
    return level


def _after(key: tuple, points: pd.DataFrame, stairs: pd.DataFrame) -> pd.DataFrame:
    """Points with the first front that a run of earlier fronts leaves them."""
    keys = [c for c in points.columns if c.startswith("_o")]
    x, out = points[keys].to_numpy("f8"), points[keys].copy()
    out["base"] = 0
    if len(points) and len(stairs):
        first = int(stairs["front"].min())
        held = _Levels(len(keys))
        for front, point in zip((stairs["front"] - first).tolist(), _tails(stairs[keys].to_numpy("f8")), strict=True):
            held.put(front, point)
        found = np.array([held.first_free(0, p) for p in _tails(x)])
        out["base"] = np.where(found > 0, found + first, 0)
    return out


def _ranked(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
    keys = [c for c in points.columns if c.startswith("_o")]
    return points[keys].assign(front=_levels(points[keys].to_numpy("f8"), points["base"].to_numpy("i8")).astype("i4"))


def fronts(points: DataFrame, objectives: list[str], minimize: bool = True, block: int = RANGE) -> DataFrame:
    """``points`` with ``front``: 0 for the frontier, 1 for that of the rest, and so on, until nothing is left.

    Distinct values are dealt out by ranges of their order, of about ``block``. If all objectives but
    one have few combinations of values, ranges are worked on at once (``_by_cells``). Else, range
    by range, many tasks hold a range's points against the staircases of the fronts so far, and
    one finds the fronts inside the range. Every step is stored; no point passes the driver.
    """
    values = _objectives(objectives, minimize)
    keys = list(values)
    rows = points.withColumns(values)
    distinct = kept(rows.select(*keys).distinct())
    count = distinct.count()
    parts = max(1, -(-count // block))
    lead, cells = _cells(distinct, keys) if parts > 1 else (None, None)
    done = _by_ranges(distinct, keys, parts, block) if cells is None else _by_cells(distinct, lead, cells, parts)
    return rows.join(done, keys).select(*points.columns, "front")


def _by_ranges(distinct: DataFrame, keys: list[str], parts: int, block: int) -> DataFrame:
    """(keys, front) of distinct points, range by range."""
    ddl = ", ".join(f"{k} double" for k in keys)
    if parts > 1:
        distinct = kept(ranges(distinct, parts, keys).withColumn("range", F.spark_partition_id()))
    done, stairs = None, None
    for k in range(parts):
        own = distinct.where(F.col("range") == k).drop("range") if parts > 1 else distinct
        if stairs is None:
            own = own.withColumn("base", F.lit(0))
        else:
            own = _bases(own, stairs, keys, block)
        front = kept(own.groupBy(F.lit(0).alias("g")).applyInPandas(_ranked, f"{ddl}, front int"))
        done = front if done is None else done.unionByName(front)
        if k < parts - 1:
            stairs = kept(_stairs(front if stairs is None else stairs.unionByName(front), keys))
    return done


def _cells(distinct: DataFrame, keys: list[str]) -> tuple[str | None, pd.DataFrame | None]:
    """The objective without which points have the fewest combinations of values, and these; None where they are too many."""
    others = {k: [o for o in keys if o != k] for k in keys}
    about = distinct.agg(*[F.approx_count_distinct(F.struct(*o) if o else F.lit(0)).alias(k) for k, o in others.items()]).first()
    lead = min(keys, key=lambda k: about[k])
    if about[lead] > 2 * CELLS:
        return None, None
    # At most one more than the bound.
    found = distinct.select(*others[lead]).distinct().limit(CELLS + 1).collect() if others[lead] else [()]
    if len(found) > CELLS:
        return None, None
    return lead, pd.DataFrame(sorted(map(tuple, found)), columns=others[lead], index=range(len(found)), dtype="f8")


def _by_cells(distinct: DataFrame, lead: str, cells: pd.DataFrame, parts: int) -> DataFrame:
    """(keys, front) of distinct points whose values but ``lead`` are among ``cells``.

    A point's front is the length of the longest chain of points under it. In order of ``lead``,
    all that later points have to know is the longest chain that ends at or under each cell. A
    range's chains from each cell to each cell say what it makes of any such numbers: all
    ranges find them at once, one task goes through these small tables in order, and all
    ranges find their fronts at once.
    """
    keys = [lead, *cells.columns]
    n = len(cells)
    under = (cells.to_numpy()[:, None] <= cells.to_numpy()).all(2)
    index = pd.MultiIndex.from_frame(cells) if len(keys) > 1 else None

    def cell_of(points: pd.DataFrame) -> list[int]:
        return [0] * len(points) if index is None else index.get_indexer(pd.MultiIndex.from_frame(points[list(cells.columns)])).tolist()

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The longest chain of a range's points that ends in each cell, by the cell in which it begins."""
        below = [np.flatnonzero(under[:, c]) for c in range(n)]
        held = np.full((n, n), -(2**30), "i4")
        number = None
        for batch in batches:
            for c in cell_of(batch):
                longest = np.maximum.reduce(held.take(below[c], 0))
                longest += 1
                if longest[c] < 1:
                    longest[c] = 1
                held[c] = longest
            number = batch["range"].iloc[0] if len(batch) else number
        if number is not None:
            yield pd.DataFrame({"range": [number], "chains": [held.tobytes()]})

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The longest chain of all earlier ranges that ends at or under each cell; ranges come in order."""
        longest = np.zeros(n, "i8")
        for batch in batches:
            out = []
            for data in batch["chains"]:
                out.append(longest.tobytes())
                ends = (np.frombuffer(data, "i4").reshape(n, n) + longest).max(1)
                longest = np.maximum(longest, np.where(under, ends[:, None], 0).max(0))
            yield pd.DataFrame({"range": batch["range"], "longest": out})

    def levels(key: tuple, points: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        points = points[keys].sort_values(keys, ignore_index=True)
        longest = np.frombuffer(start["longest"].iloc[0], "i8").copy()
        above, front = under.astype("i8"), np.zeros(len(points), "i4")
        for k, c in enumerate(cell_of(points)):
            front[k] = level = longest.item(c)
            np.maximum(longest, above[c] * (level + 1), out=longest)
        return points.assign(front=front)

    dealt = kept(ranges(distinct.select(*keys), parts, keys).withColumn("range", F.spark_partition_id()))
    # A table of cells by cells for each range, so one task reads little.
    tables = dealt.mapInPandas(chains, "range int, chains binary").repartition(1).sortWithinPartitions("range")
    starts = tables.mapInPandas(before, "range int, longest binary")
    ddl = ", ".join(f"{k} double" for k in keys)
    return kept(dealt.groupBy("range").cogroup(starts.groupBy("range")).applyInPandas(levels, f"{ddl}, front int"))


def _stairs(front: DataFrame, keys: list[str]) -> DataFrame:
    """Of each front the points that matter to later ranges: the minimal ones of all values but the first."""
    if len(keys) > 3:
        return front
    last = keys[-1]
    if len(keys) < 3:
        return front.groupBy("front").agg(*[F.min(k).alias(k) for k in keys])
    w = Window.partitionBy("front").orderBy(keys[1], last, keys[0]).rowsBetween(Window.unboundedPreceding, -1)
    lower = F.min(last).over(w)
    return front.withColumn("_low", lower).where(F.col("_low").isNull() | (F.col(last) < F.col("_low"))).drop("_low")


def _bases(points: DataFrame, stairs: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Points with ``base``, the first front that earlier ranges leave them: each of some groups of
    points is held against each of some runs of fronts."""
    spark = points.sparkSession
    total = stairs.count()
    runs = max(1, -(-total // size))
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ddl = ", ".join(f"{k} double" for k in keys)
    if runs > 1:
        stairs = ranges(stairs, runs, ["front", *keys]).withColumn("run", F.spark_partition_id())
    else:
        stairs = stairs.withColumn("run", F.lit(0))
    rows = points.withColumn("group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    held = stairs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cut = rows.select("group", "run", *keys).groupBy("group", "run").cogroup(held.select("group", "run", "front", *keys).groupBy("group", "run"))
    return cut.applyInPandas(_after, f"{ddl}, base int").groupBy(*keys).agg(F.max("base").alias("base"))


def crowding(points: DataFrame, objectives: list[str], front: str, tie: str) -> DataFrame:
    """With ``crowding``: the sum of relative gaps between a point's neighbours in each objective.

    Ends of an objective, and all points of a front of two or fewer, are infinite. Gaps are the
    same whichever end is the better, so one form serves minimized and maximized objectives.
    """
    size = Window.partitionBy(front)
    rows = points.withColumn("_n", F.count("*").over(size))
    gaps, ends = [], []
    for o in objectives:
        w = Window.partitionBy(front).orderBy(o, tie)
        rows = rows.withColumns({f"_p_{o}": F.lag(o).over(w), f"_q_{o}": F.lead(o).over(w), f"_s_{o}": F.max(o).over(size) - F.min(o).over(size)})
        ends.append(F.col(f"_p_{o}").isNull() | F.col(f"_q_{o}").isNull())
        gaps.append(F.when(F.col(f"_s_{o}") > 0, (F.col(f"_q_{o}") - F.col(f"_p_{o}")) / F.col(f"_s_{o}")).otherwise(0.0))
    total = reduce(lambda a, b: a + b, [F.coalesce(g, F.lit(0.0)) for g in gaps])
    infinite = reduce(lambda a, b: a | b, ends) | (F.col("_n") <= 2)
    return rows.withColumn("crowding", F.when(infinite, float("inf")).otherwise(total)).select(*points.columns, "crowding")


def select_best(points: DataFrame, count: int, tie: str) -> DataFrame:
    """The best ``count`` of rows with front and crowding."""
    return points.orderBy("front", F.desc("crowding"), tie).limit(count)


def compromise(front: DataFrame, objectives: list[str], tie: str) -> DataFrame:
    """The row nearest to the ideal of all objectives, each scaled to its range (maximized)."""
    span = front.agg(*[F.min(o).alias(f"_lo_{o}") for o in objectives], *[F.max(o).alias(f"_hi_{o}") for o in objectives])
    rows = front.crossJoin(F.broadcast(span))  # one row
    part = lambda o: F.when(F.col(f"_hi_{o}") > F.col(f"_lo_{o}"), F.pow(1 - (F.col(o) - F.col(f"_lo_{o}")) / (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")), 2)).otherwise(0.0)
    distance = F.sqrt(reduce(lambda a, b: a + b, [part(o) for o in objectives]))
    return rows.withColumn("distance", distance).orderBy(F.round("distance", 9), tie).limit(1).select(*front.columns, "distance")


def champions(front: DataFrame, objectives: list[str], tie: str) -> DataFrame:
    """(objective, member, value): the first row that is best in each objective."""
    best = front.agg(*[F.max(F.struct(F.col(o).cast("double").alias("value"), (-F.col(tie)).alias("k"))).alias(o) for o in objectives])
    return best.select(F.inline(F.array(*[F.struct(F.lit(o).alias("objective"), (-F.col(f"{o}.k")).alias("member"), F.col(f"{o}.value").alias("value")) for o in objectives])))


def hypervolume_2d(points: DataFrame, x: str, y: str, ref: tuple[float, float], group: str | None = None) -> DataFrame:
    """Area that points dominate over a reference, both maximized, for each group.

    Only the best y of each x counts; by falling x, each adds the strip above the best y so
    far, which is a running maximum.
    """
    keys = [group] if group else []
    rows = points.where((F.col(x) > ref[0]) & (F.col(y) > ref[1])).groupBy(*keys, F.col(x).alias("_x")).agg(F.max(y).alias("_y"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.max("_y").over(w), F.lit(float(ref[1])))
    strips = rows.withColumn("_above", above).withColumn("_strip", (F.col("_x") - ref[0]) * F.greatest(F.lit(0.0), F.col("_y") - F.col("_above")))
    return strips.groupBy(*keys).agg(F.sum("_strip").alias("hypervolume"))


def _volume(points: np.ndarray, before: np.ndarray, low: float) -> float:
    """Volume over 0 of slabs from the highest z of ``points`` (x, y, z) down to ``low``; ``before`` are points (x, y) of higher z.

    The area under the staircase grows by what a new point covers beyond it.
    """
    x, y = [0.0], [float("inf")]  # rising x, falling y; the corner of no area
    area = total = 0.0

    def put(a: float, b: float) -> float:
        k = bisect_left(x, a)
        if k < len(x) and y[k] >= b:
            return 0.0
        gained, right, j = 0.0, y[k] if k < len(y) else 0.0, k
        # Steps to the left are covered up to the first that is higher.
        end, floor = a, right
        while True:
            j -= 1
            gained += (end - x[j]) * (b - floor)
            if y[j] > b:
                break
            end, floor = x[j], y[j]
        last = k + 1 if k < len(x) and x[k] == a else k
        x[j + 1 : last] = [a]
        y[j + 1 : last] = [b]
        return gained

    for a, b in before.tolist():
        area += put(a, b)
    rows = points[np.argsort(-points[:, 2], kind="stable")].tolist()
    for k, (a, b, c) in enumerate(rows):
        area += put(a, b)
        total += area * (c - (rows[k + 1][2] if k + 1 < len(rows) else low))
    return total


def _plane_front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each run of a group in a partition: the points (x, y) that no other is over, and its highest z."""
    left: pd.DataFrame | None = None

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby(["g", "part"], dropna=False, sort=False):
            front = -_front(-own[["x", "y"]].to_numpy("f8"))
            out.append(pd.DataFrame({"g": [own["g"].iloc[0]] * len(front), "part": own["part"].iloc[0], "x": front[:, 0], "y": front[:, 1], "top": own["z"].max() if "z" in own else own["top"].max()}))
        return pd.concat(out, ignore_index=True)

    for batch in batches:
        if len(batch):
            batch = best(batch)
            if left is None:
                left = batch
            else:
                top = pd.concat([left, batch], ignore_index=True)
                left = best(top)
    if left is not None:
        yield left


def hypervolume_3d(points: DataFrame, axes: tuple[str, str, str], ref: tuple[float, float, float], group: str) -> DataFrame:
    """Volume that points dominate over a reference, all maximized, for each group.

    Points are dealt out by ranges of group and falling z. A range's part of a group is a task's:
    its slabs lie on the staircase (x, y) of the group's ranges above, which is all that it needs
    of them.
    """
    x, y, z = axes
    spark = points.sparkSession
    over = reduce(lambda a, b: a & b, [F.col(c) > r for c, r in zip(axes, ref, strict=True)])
    rows = points.where(over).select(F.col(group).alias("g"), *[(F.col(c).cast("double") - r).alias(n) for c, r, n in zip(axes, ref, "xyz", strict=True)])
    best = rows.groupBy("g", "x", "y").agg(F.max("z").alias("z"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = kept(ranges(best.withColumn("down", -F.col("z")), parts, ["g", "down", "x", "y"]).drop("down").withColumn("part", F.spark_partition_id()))
    kind = dict(dealt.dtypes)["g"]
    fronts_ = kept(dealt.mapInPandas(_plane_front, f"g {kind}, part int, x double, y double, top double"))
    runs = fronts_.groupBy("g", "part").agg(F.max("top").alias("top"))
    w = Window.partitionBy("g").orderBy("part")
    runs = runs.select("g", "part", F.coalesce(F.lead("top").over(w), F.lit(0.0)).alias("low"), F.lead("part").over(w).alias("next"))
    later = runs.select(F.col("g").alias("g2"), F.col("part").alias("p2"))
    above = fronts_.join(later, F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") < F.col("p2"))).select("g", F.col("p2").alias("part"), "x", "y")
    bounded = dealt.join(runs.select(F.col("g").alias("g2"), F.col("part").alias("p2"), "low"), F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") == F.col("p2"))).select("g", "part", "x", "y", "z", "low")

    def volume(key: tuple, own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"g": [], "volume": []})
        total = _volume(own[["x", "y", "z"]].to_numpy("f8"), before[["x", "y"]].to_numpy("f8").reshape(-1, 2), float(own["low"].iloc[0]))
        return pd.DataFrame({"g": own["g"].iloc[:1], "volume": [total]})

    sums = bounded.groupBy("g", "part").cogroup(above.groupBy("g", "part")).applyInPandas(volume, f"g {kind}, volume double")
    volumes = sums.groupBy("g").agg(F.sum("volume").alias("hypervolume"))
    names = points.select(F.col(group).alias("_name")).distinct()
    return names.join(volumes, F.col("_name").eqNullSafe(F.col("g")), "left").select(F.col("_name").alias(group), F.coalesce("hypervolume", F.lit(0.0)).alias("hypervolume"))


def weighted_fitness(metrics: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """(key, score): sum of weighted objectives of (key, metric, value); a missing one makes it infinite."""
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    rows = metrics.where(F.col("metric").isin(list(weights)))
    sums = rows.groupBy(key).agg(F.countDistinct("metric").alias("_n"), F.sum(F.col("value") * F.element_at(table, F.col("metric"))).alias("_s"))
    return sums.select(key, F.when(F.col("_n") == len(weights), F.col("_s")).otherwise(float("inf")).alias("score"))
