"""State with a lifetime of its own: routes that are forgotten by the clock, and series that fall silent.

Both keep their state in the store's typed forms, a map and values by key, of which Spark drops
what is past its lifetime, so no key's state is read only to clear it. Timers run by the clock.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.stats import ACCELERATION_EPSILON, PATIENCE, VELOCITY_EPSILON

ROUTES = "key string, seq long, strategy string, depth int"
WATCHED = "series string, seq long, velocity double, acceleration double, stall long, event string"
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def prepared(spark) -> None:
    """Chooses the state store that typed state needs, where the session hasn't."""
    for key, value in PROVIDER.items():
        spark.conf.set(key, value)


class RouteMemory(StatefulProcessor):
    """The strategies that a key has taken, each for its lifetime."""

    def __init__(self, cascade: list[str], last: str, most: int, lifetime_ms: int):
        self._cascade, self._last, self._most, self._lifetime = cascade[:most], last, min(most, len(cascade)), lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._taken = handle.getMapState("taken", "strategy string", "seq long", self._lifetime)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows), ignore_index=True).sort_values("seq")
        out = []
        for r in own.itertuples():
            if r.score >= r.minimum:
                out.append((key[0], r.seq, r.strategy, 0))
                continue
            depth, strategy = next(((d, s) for d, s in enumerate(self._cascade, 1) if not self._taken.containsKey((s,))), (self._most, self._last))
            if strategy != self._last:
                self._taken.updateValue((strategy,), (int(r.seq),))
            out.append((key[0], r.seq, strategy, depth))
        yield pd.DataFrame(out, columns=["key", "seq", "strategy", "depth"])

    def close(self) -> None:
        pass


def remembered_routes(requests: DataFrame, cascade: list[str], last: str, most: int = 3, lifetime: float = 300.0) -> DataFrame:
    """(key, seq, strategy, depth) of a stream of requests (key, seq, strategy, score, minimum), in the order of ``seq`` in a batch.

    A request under its confidence takes the first strategy of the cascade that its key hasn't
    taken for ``lifetime`` seconds by the clock, or the last resort.
    """
    prepared(requests.sparkSession)
    memory = RouteMemory(cascade, last, most, int(lifetime * 1000))
    return requests.groupBy("key").transformWithStateInPandas(memory, ROUTES, "Append", "ProcessingTime")


class SeriesWatch(StatefulProcessor):
    """The last two scores, the stall and whether it was told of a series, and a timer for its silence."""

    def __init__(self, silence_ms: int, lifetime_ms: int):
        self._silence, self._lifetime = silence_ms, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("kinetics", "step long, b double, c double, stall long, alarmed boolean, seq long", self._lifetime)
        self._timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        step, b, c, stall, alarmed, seq = self._state.get() if self._state.exists() else (0, 0.0, 0.0, 0, False, 0)
        out = []
        for seq, score in pd.concat(list(rows), ignore_index=True).sort_values("seq")[["seq", "score"]].itertuples(index=False):
            v = 0.0 if score is None or math.isnan(score) or math.isinf(score) else float(score)
            step += 1
            velocity = v - b if step >= 2 else 0.0
            acceleration = velocity - (b - c) if step >= 3 else 0.0
            stall = stall + 1 if step >= 3 and abs(velocity) < VELOCITY_EPSILON and abs(acceleration) < ACCELERATION_EPSILON else 0
            event = "alarm" if stall >= PATIENCE and not alarmed else None
            alarmed, b, c = stall >= PATIENCE, v, b
            out.append((key[0], int(seq), velocity, acceleration, int(stall), event))
        self._state.update((int(step), b, c, int(stall), bool(alarmed), int(seq)))
        if self._timer.exists():
            self._handle.deleteTimer(self._timer.get()[0])
        at = int(timerValues.getCurrentProcessingTimeInMs()) + self._silence
        self._handle.registerTimer(at)
        self._timer.update((at,))
        yield pd.DataFrame(out, columns=["series", "seq", "velocity", "acceleration", "stall", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stall, seq = (int(self._state.get()[3]), int(self._state.get()[5])) if self._state.exists() else (0, -1)
        self._timer.clear()
        yield pd.DataFrame([(key[0], seq, 0.0, 0.0, stall, "silent")], columns=["series", "seq", "velocity", "acceleration", "stall", "event"])

    def close(self) -> None:
        pass


def watched_series(scores: DataFrame, silence: float = 60.0, lifetime: float = 86_400.0) -> DataFrame:
    """A stream (series, seq, score) with velocity, acceleration, stall and events: one ``alarm`` a plateau, and ``silent`` for a series without a score for so many seconds.

    A series that has been silent for ``lifetime`` seconds begins anew.
    """
    prepared(scores.sparkSession)
    watch = SeriesWatch(int(silence * 1000), int(lifetime * 1000))
    return scores.groupBy("series").transformWithStateInPandas(watch, WATCHED, "Append", "ProcessingTime")
