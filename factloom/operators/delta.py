"""Differences between snapshots."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, status): changed, created or removed; what is the same gives no row."""
    a = before.select(key, F.col(fingerprint).alias("_a"))
    b = after.select(key, F.col(fingerprint).alias("_b"))
    status = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").withColumn("status", status).where("status is not null").select(key, "status")


def boundary_violations(diff: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Differences whose key is not on the list."""
    return diff.join(allowed.select(key).distinct(), key, "left_anti")


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of lines.

    Equal ends are cut off; then matches are threaded: for each length the chain with the
    least last place in ``b`` is held, and each line of ``a`` extends chains by its places in ``b``.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    places: dict[str, list[int]] = {}
    for k in range(len(b) - high - 1, low - 1, -1):
        places.setdefault(b[k], []).append(k)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(low, len(a) - high):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            chain = (i, j, chains[k - 1] if k else None)
            ends[k : k + 1] = [j]
            chains[k : k + 1] = [chain]
    middle, chain = [], chains[-1] if chains else None
    while chain:
        middle.append(chain[:2])
        chain = chain[2]
    return [(k, k) for k in range(low)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]


def merged_lines(base: list[str], left: list[str], right: list[str]) -> tuple[list[str], int]:
    """Three versions of lines as one, and the number of regions that both sides changed apart.

    Lines of the base that both sides kept part the texts into regions. A region that one side
    left as it was is the other's; one that both made the same is theirs; else it is a
    conflict, and the right side's.
    """
    to_left, to_right = dict(common_lines(base, left)), dict(common_lines(base, right))
    fixed = [(k, to_left[k], to_right[k]) for k in range(len(base)) if k in to_left and k in to_right]
    out: list[str] = []
    conflicts = 0
    x = y = z = 0
    for i, j, k in [*fixed, (len(base), len(left), len(right))]:
        b, l, r = base[x:i], left[y:j], right[z:k]  # noqa: E741
        conflicts += l != r and b not in (l, r)
        out += l if r == b else r
        out += base[i : i + 1]
        x, y, z = i + 1, j + 1, k + 1
    return out, conflicts


def merged_texts(rows: DataFrame, base: str, left: str, right: str) -> DataFrame:
    """``rows`` with ``merged`` and ``conflicts`` of three columns of text, line by line; null is empty."""

    @F.pandas_udf("merged string, conflicts long")
    def merge(b: pd.Series, l: pd.Series, r: pd.Series) -> pd.DataFrame:  # noqa: E741
        found = [merged_lines(*((t or "").split("\n") for t in three)) for three in zip(b, l, r, strict=True)]
        return pd.DataFrame({"merged": ["\n".join(lines) for lines, _ in found], "conflicts": [n for _, n in found]})

    out = rows.withColumn("_merge", merge(base, left, right))
    return out.withColumns({"merged": F.col("_merge.merged"), "conflicts": F.col("_merge.conflicts")}).drop("_merge")


def three_way_merge(base: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], value: str, lines: bool = False) -> DataFrame:
    """(keys, value, outcome) of three versions of entities.

    Unchanged or changed on one side: that side's. Changed alike: it. Changed apart: a
    conflict that keeps the right one. Deleted on one side and changed on the other: a
    conflict that keeps the changed one. Deleted otherwise: gone. Added on one side: kept.
    With ``lines``, texts that were changed apart are merged line by line first, and are a
    conflict only where a region is.
    """
    side = lambda df, n: df.select(*keys, F.col(value).alias(n), F.lit(True).alias(f"has_{n}"))
    rows = side(base, "b").join(side(left, "l"), keys, "full_outer").join(side(right, "r"), keys, "full_outer")
    has = lambda n: F.coalesce(F.col(f"has_{n}"), F.lit(False))
    b, l, r = F.col("b"), F.col("l"), F.col("r")  # noqa: E741
    same = lambda x, y: x.eqNullSafe(y)
    out = (
        F.when(has("l") & has("r") & same(l, r), F.struct(r.alias("v"), F.lit("same").alias("o")))
        .when(has("b") & has("l") & has("r") & same(l, b), F.struct(r.alias("v"), F.lit("right").alias("o")))
        .when(has("b") & has("l") & has("r") & same(r, b), F.struct(l.alias("v"), F.lit("left").alias("o")))
        .when(has("l") & has("r"), F.struct(r.alias("v"), F.lit("conflict").alias("o")))
        .when(has("b") & has("l") & ~has("r") & ~same(l, b), F.struct(l.alias("v"), F.lit("conflict").alias("o")))
        .when(has("b") & has("r") & ~has("l") & ~same(r, b), F.struct(r.alias("v"), F.lit("conflict").alias("o")))
        .when(~has("b") & has("l"), F.struct(l.alias("v"), F.lit("left").alias("o")))
        .when(~has("b") & has("r"), F.struct(r.alias("v"), F.lit("right").alias("o")))
    )
    rows = rows.withColumn("x", out).where("x is not null")
    if not lines:
        return rows.select(*keys, F.col("x.v").alias(value), F.col("x.o").alias("outcome"))
    # Only what both sides changed is looked into.
    apart = (F.col("x.o") == "conflict") & has("b") & has("l") & has("r")
    some = lambda c: F.when(apart, F.col(c))
    rows = merged_texts(rows.withColumns({"_b": some("b"), "_l": some("l"), "_r": some("r")}), "_b", "_l", "_r")
    woven = apart & (F.col("conflicts") == 0)
    return rows.select(*keys, F.when(woven, F.col("merged")).otherwise(F.col("x.v")).alias(value), F.when(woven, F.lit("merged")).otherwise(F.col("x.o")).alias("outcome"))
