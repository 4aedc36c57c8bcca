"""Mixing sources to target weights, in DataFrame operations only.

A source's weight is its share of tokens to an exponent, normalised. The exponent is
bisected (many points of the interval in one aggregate) until the weights' entropy reaches
a target, or no source is repeated more often than allowed. The weights are then realised
as block permutations under a token budget: each pass over a source is a permutation by
hash, the running token position within a source tells the pass and the block, and a
document goes out as often as positions of it lie under the source's budget.

Running positions are prefix sums in two levels: a permutation is cut into ranges of the
hash of about ``bucket_docs`` documents, so a source with a third of all rows is many
groups, and only the ranges' totals are summed per source.

Defined results: null source is a source of its own, null text has no words; documents of
sources without any token go out once; rows that agree in id, source and text move
together (``n_rows``); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Interior points of the interval that one aggregate tries, and aggregates: 33 ** 7 parts.
POINTS, ROUNDS = 32, 7
KEY_SPACE = 1 << 60
DIGITS = 6


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _section(sources: DataFrame, measure, accept) -> float:
    """The smallest exponent in [0, 1] that ``accept`` takes; 1 if none does.

    ``measure`` gives the aggregate columns for an exponent; what is accepted at one
    exponent is accepted at all larger ones.
    """
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        at = [lo + (hi - lo) * k / (POINTS + 1) for k in range(0, POINTS + 1)]
        row = sources.agg(*[c.alias(f"c{k}_{j}") for k, a in enumerate(at) for j, c in enumerate(measure(a))]).first()
        found = next((k for k, _ in enumerate(at) if accept(at[k], [row[f"c{k}_{j}"] for j in range(len(measure(0.0)))])), None)
        if found == 0:
            return lo
        if found is None:
            lo = at[-1]
        else:
            lo, hi = at[found - 1], at[found]
    return hi


def temperature_exponent(sources: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget: float | None) -> float:
    """The exponent for frames of (share, tokens).

    The largest with at least ``target_entropy`` of the greatest possible entropy; raised,
    if need be, until no source is passed more than ``repetition_limit`` times. Without a
    ``budget`` the least is meant that passes each source once at least.
    """
    count, total, most = sources.agg(F.count("*"), F.sum("tokens"), F.max("share")).first()
    if not count or count == 1:
        return 1.0
    power = lambda a: F.sum(F.pow("share", F.lit(a)))
    alpha = 1.0 if target_entropy is None else 0.0
    if target_entropy is not None:
        want = target_entropy * math.log(count)

        def entropy(a: float, x: list) -> float:
            return math.log(x[0]) - a * x[1] / x[0]

        measure = lambda a: (power(a), F.sum(F.pow("share", F.lit(a)) * F.log("share")))
        # Entropy falls as the exponent rises: the smallest that is too large, less a hair.
        alpha = _section(sources, measure, lambda a, x: entropy(a, x) < want)
    if repetition_limit is not None:

        def repeated(a: float, x: list) -> float:
            return x[1] / most ** (a - 1) if budget is None else budget * x[1] / x[0] / total

        measure = lambda a: (power(a), F.max(F.pow("share", F.lit(a - 1))))
        least = _section(sources, measure, lambda a, x: repeated(a, x) <= repetition_limit)
        alpha = least if target_entropy is None else max(alpha, least)
    return round(alpha, DIGITS)


def mixture_weights(units: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget_tokens: int | None = None, cover: bool = False) -> DataFrame:
    """(source, docs, tokens, share, weight, budget): budget in tokens, rounded to whole ones.

    ``budget_tokens`` is the size of the mix, by default the size of the corpus; ``cover``
    instead takes the least size at which every source is passed once at least.
    """
    sums = units.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("n_rows")).alias("tokens"))
    sums = stored(sums, "mix-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    live = sums.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total)))
    alpha = temperature_exponent(live, target_entropy, repetition_limit, None if cover else float(budget_tokens or total))
    z, most = live.agg(F.sum(F.pow("share", F.lit(alpha))), F.max("share")).first()
    if z is None:
        return sums.select("*", F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    size = float(total) * z * most ** (1 - alpha) if cover else float(budget_tokens or total)
    weight = F.round(F.pow("share", F.lit(alpha)) / F.lit(z), 9)
    budget = F.greatest(F.round(weight * F.lit(size)).cast("long"), F.when(F.lit(cover), F.col("tokens")))
    none = sums.where("tokens = 0").select("*", F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    return live.select("*", weight.alias("weight"), budget.alias("budget")).unionByName(none)


def units_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, source, text_md5) with n_tokens and the rows that agree in them."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_md5"), word_tokens(F.col(text_col)).alias("n_tokens"))
    return rows.groupBy("doc_id", "source", "text_md5").agg(F.first("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))


def block_permutations(units: DataFrame, weights: DataFrame, seed: int, block_tokens: int, bucket_docs: int = 2000) -> DataFrame:
    """(doc_id, source, text_md5, n_tokens, n_rows, epoch, block, order_key).

    Block k of the mix holds the rows of all sources whose position starts within its part
    of the source's budget; within a block, ascending ``order_key`` is the order.
    """
    w = weights.select(F.col("source").alias("w_source"), "docs", "tokens", "budget", (F.col("weight") * F.lit(float(block_tokens))).alias("per_block"))
    # The number of sources is unbounded: no hint; Spark broadcasts it below its threshold.
    rows = units.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    passes = F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1))).where("epoch >= 0")
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5"))
    rows = rows.withColumn("order_key", F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("bucket", F.expr(f"order_key div ({KEY_SPACE} div (docs div {bucket_docs} + 1) + 1)"))
    rows = rows.withColumn("size", F.col("n_tokens") * F.col("n_rows"))
    keys = ["source", "epoch", "bucket"]
    totals = rows.groupBy(*keys).agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("sum")
    firsts = totals.select(F.col("source").alias("f_source"), F.col("epoch").alias("f_epoch"), F.col("bucket").alias("f_bucket"), before.alias("first"))
    inside = F.sum("size").over(Window.partitionBy(*keys).orderBy("order_key", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    same = F.col("source").eqNullSafe(F.col("f_source")) & (F.col("epoch") == F.col("f_epoch")) & (F.col("bucket") == F.col("f_bucket"))
    placed = rows.withColumn("inside", inside).join(firsts, same)
    start = F.col("epoch") * F.col("tokens") + F.col("first") + F.col("inside")
    # What has no tokens and stands behind the last of a whole pass is of that pass.
    behind = (F.col("size") == 0) & (F.col("start") == F.col("budget"))
    placed = placed.withColumn("start", start).where((F.col("start") < F.col("budget")) | (F.col("tokens") == 0) | behind)
    block = F.when(F.col("per_block") > 0, F.floor(F.col("start") / F.col("per_block"))).otherwise(0).cast("long")
    return placed.select("doc_id", "source", "text_md5", "n_tokens", "n_rows", "epoch", block.alias("block"), "order_key")


def mix(docs: DataFrame, target_entropy: float | None = 0.95, repetition_limit: float | None = 4.0, budget_tokens: int | None = None, cover: bool = False, seed: int = 7, block_tokens: int = 1_000_000, **columns) -> DataFrame:
    """The mix of ``docs`` as a table of places; see ``block_permutations``."""
    units = stored(units_of(docs, **columns), "mix-units")
    return block_permutations(units, mixture_weights(units, target_entropy, repetition_limit, budget_tokens, cover), seed, block_tokens)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with its columns."""
    names = unused(docs, "_mix_id", "_mix_source", "_mix_md5")
    places = mix(docs, **options).select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "source", "text_md5"), names, strict=True)])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & F.col("source").cast("string").eqNullSafe(F.col(names[1])) & (F.md5(F.coalesce("text", F.lit("")).cast("binary")) == F.col(names[2]))
    return docs.join(places, same).select(*[docs[c] for c in docs.columns])


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "n_rows", "epoch", "block", "order_key")


OP10_SQL = """
WITH RECURSIVE units AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens, count(*) AS n_rows
  FROM documents GROUP BY ALL),
sums AS (SELECT source, count(*) AS docs, sum(n_tokens * n_rows)::BIGINT AS tokens FROM units GROUP BY 1),
live AS (SELECT *, tokens / (SELECT sum(tokens) FROM sums)::DOUBLE AS share FROM sums WHERE tokens > 0),
h AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT k, lo, hi,
    (SELECT ln(sum(share ** ((h.lo + h.hi) / 2))) - ((h.lo + h.hi) / 2) * sum(share ** ((h.lo + h.hi) / 2) * ln(share)) / sum(share ** ((h.lo + h.hi) / 2)) FROM live)
      >= 0.95 * (SELECT ln(count(*)) FROM live) AS ok
    FROM h WHERE k < 45)),
r AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT k, lo, hi,
    (SELECT max(share ** ((r.lo + r.hi) / 2 - 1)) / sum(share ** ((r.lo + r.hi) / 2)) FROM live) <= 4.0 AS ok
    FROM r WHERE k < 45)),
a AS (SELECT round(greatest((SELECT hi FROM h WHERE k = 45), (SELECT hi FROM r WHERE k = 45)), 6) AS alpha),
w AS (
  SELECT source, docs, tokens, round(share ** alpha / (SELECT sum(share ** alpha) FROM live), 9) AS weight,
         round(round(share ** alpha / (SELECT sum(share ** alpha) FROM live), 9) * (SELECT sum(tokens) FROM sums))::BIGINT AS budget
  FROM live, a
  UNION ALL SELECT source, docs, tokens, 0.0, 0 FROM sums WHERE tokens = 0),
occ AS (
  SELECT u.*, w.docs, w.tokens, w.budget, w.weight * 1000000.0 AS per_block,
         unnest(range(0, CASE WHEN tokens > 0 THEN ceil(budget / tokens)::BIGINT ELSE 1 END))::INT AS epoch
  FROM units u JOIN w ON u.source IS NOT DISTINCT FROM w.source),
keyed AS (
  SELECT *, ('0x' || substring(md5('7|' || coalesce(source, '') || '|' || epoch || '|' || coalesce(doc_id::VARCHAR, '') || '|' || text_md5), 1, 15))::BIGINT AS order_key FROM occ),
placed AS (
  SELECT *, epoch * tokens + sum(n_tokens * n_rows) OVER (PARTITION BY source, epoch ORDER BY order_key, doc_id, text_md5 ROWS UNBOUNDED PRECEDING) - n_tokens * n_rows AS start
  FROM keyed)
SELECT doc_id, source, n_tokens, n_rows::BIGINT AS n_rows, epoch, CASE WHEN per_block > 0 THEN floor(start / per_block) ELSE 0 END::BIGINT AS block, order_key
FROM placed WHERE start < budget OR tokens = 0 OR (n_tokens = 0 AND start = budget)
"""
