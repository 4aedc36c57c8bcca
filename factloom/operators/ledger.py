"""Hash chains, keyed upserts and visit weights."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_hash(previous: Column, index: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), index.cast("string"), F.lit("|"), payload).cast("binary"), 256)


def canonical(fields: dict[str, Column]) -> Column:
    """JSON text with sorted keys; strings are escaped by Spark's writer, the rest stands as it is cast."""
    parts = []
    for k in sorted(fields):
        parts.append(F.concat(F.lit(f'"{k}": '), F.coalesce(fields[k].cast("string"), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def chained(rows: DataFrame, chain: str, order: str, payload: str, tails: DataFrame | None = None) -> DataFrame:
    """(chain, t_causal, prev_hash, payload, block_hash): each chain's payloads hashed in order.

    A hash needs the one before, so a chain is read in order by one task, a row at a time; what is
    held is the last hash. A block without payload has no hash, and the next begins anew. With
    ``tails`` (chain, tail, next) chains go on behind their last blocks.
    """
    kind = dict(rows.dtypes)[chain]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, t, last = None, 0, ""
        for batch in batches:
            out = []
            for known, c, p, tail, start in zip(*(batch[x].tolist() for x in ("known", "chain", "payload", "tail", "next")), strict=True):
                if now != (known, c if known else None):
                    now, t, last = (known, c if known else None), start, tail
                made = None if p is None else hashlib.sha256(f"{last}|{t}|{p}".encode()).hexdigest()
                out.append((t, last, made))
                t, last = t + 1, made or ""
            t_, prev, made = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({chain: batch["chain"], "t_causal": t_, "prev_hash": prev, "payload": batch["payload"], "block_hash": made})

    cols = rows.select(F.col(chain).alias("chain"), F.col(order).alias("o"), F.col(payload).cast("string").alias("payload"), F.col(chain).isNotNull().alias("known"))
    if tails is None:
        cols = cols.withColumns({"tail": F.lit(""), "next": F.lit(0).cast("long")})
    else:
        cols = cols.join(tails.select(F.col(chain).alias("chain"), "tail", "next"), "chain", "left").withColumns({"tail": F.coalesce("tail", F.lit("")), "next": F.coalesce("next", F.lit(0).cast("long"))})
    sorted_ = cols.repartition("chain").sortWithinPartitions("chain", "o", "payload").select("chain", "payload", "known", "tail", "next")
    return sorted_.mapInPandas(run, f"{chain} {kind}, t_causal long, prev_hash string, payload string, block_hash string")


def chain_faults(ledger: DataFrame, chain: str, content: bool = True) -> DataFrame:
    """(chain, t_causal, fault) of blocks that don't follow the one before, or whose hash is not theirs."""
    w = Window.partitionBy(chain).orderBy("t_causal")
    before = F.coalesce(F.lag("block_hash").over(w), F.lit(""))
    gap = F.col("t_causal") != F.row_number().over(w) - 1
    wrong = block_hash(F.col("prev_hash"), F.col("t_causal"), F.col("payload")) != F.col("block_hash")
    fault = F.when(gap, "gap").when(F.col("prev_hash") != before, "link").when(F.lit(content) & wrong, "content")
    return ledger.withColumn("fault", fault).where("fault is not null").select(chain, "t_causal", "fault")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key by version; of equal versions the change wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    values = [c for c in table.columns if c not in keys]
    latest = F.max_by(F.struct(*values), F.struct(version, "_new"))
    return both.groupBy(*keys).agg(latest.alias("_row")).select(*keys, "_row.*").select(*table.columns)


def visit_weights(visits: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """With ``weight``: how often the signature has been seen, this time included."""
    w = Window.partitionBy(*signature).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return visits.withColumn("weight", F.count("*").over(w))


def node_signatures(nodes: DataFrame, ports: DataFrame) -> DataFrame:
    """(node, signature): class, number of ports and sorted neighbours, without identities.

    ``nodes`` is (node, cls), ``ports`` (node, port, target), the target null or a node.
    """
    other = nodes.select(F.col("node").alias("target"), F.col("cls").alias("to"))
    ends = ports.join(other, "target", "left").select("node", F.concat(F.col("port"), F.lit("->"), F.coalesce("to", F.lit("-"))).alias("end"))
    own = ends.groupBy("node").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    rows = nodes.join(own, "node", "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<string>")))
    return rows.select("node", F.concat_ws("|", "cls", F.size("ends").cast("string"), F.array_join("ends", ",")).alias("signature"))
