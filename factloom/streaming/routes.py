"""Fallback routes that are remembered for a while, as state of a stream.

A request under its confidence takes the first strategy of a cascade that its key hasn't taken
within the lifetime; each it has counts one step of depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, seq long, strategy string, depth int"


def _route(pdf: pd.DataFrame, taken: dict[str, float], cascade: list[str], last: str, most: int, lifetime: float) -> list[tuple]:
    out = []
    for r in pdf.sort_values(["at", "seq"]).itertuples():
        for s in [s for s, t in taken.items() if r.at - t > lifetime]:
            del taken[s]
        if r.score >= r.minimum:
            out.append((r.key, r.seq, r.strategy, 0))
            continue
        open_ = [(d, s) for d, s in enumerate(cascade[:most], 1) if s not in taken]
        depth, strategy = open_[0] if open_ else (min(most, len(cascade)), last)
        if open_:
            taken[strategy] = r.at
        out.append((r.key, r.seq, strategy, depth))
    return out


def routed(requests: DataFrame, cascade: list[str], last: str, most: int = 3, lifetime: float = 300.0) -> DataFrame:
    """(key, seq, strategy, depth) of a batch of requests (key, seq, at, strategy, score, minimum); ``at`` in seconds.

    A key's requests follow each other in one task.
    """
    columns = ["key", "seq", "strategy", "depth"]
    run = lambda pdf: pd.DataFrame(_route(pdf, {}, cascade, last, most, lifetime), columns=columns)
    return requests.groupBy("key").applyInPandas(run, OUT)


def routed_stream(requests: DataFrame, cascade: list[str], last: str, most: int = 3, lifetime: float = 300.0) -> DataFrame:
    """The same over a stream; a key's state is a time for each strategy, and goes when the watermark says that all are over.

    Requests may be late by a lifetime.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True)
        out = pd.DataFrame(_route(rows, taken, cascade, last, most, lifetime), columns=["key", "seq", "strategy", "depth"])
        state.update((list(taken), list(taken.values())))
        state.setTimeoutTimestamp(int((float(rows["at"].max()) + 2 * lifetime) * 1000))
        yield out

    timed = requests.withColumn("time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("time", f"{int(lifetime)} seconds")
    return timed.groupBy("key").applyInPandasWithState(run, OUT, "strategies array<string>, times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
