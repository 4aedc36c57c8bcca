"""Score kinetics as a stream: the same columns as the batch form, with state by series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stats import ACCELERATION_EPSILON, PATIENCE, VELOCITY_EPSILON

OUT = "series string, seq long, velocity double, acceleration double, stall long, alarm boolean"
STATE = "step long, b double, c double, stall long, alarmed boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    step, b, c, stall, alarmed = state.get if state.exists else (0, 0.0, 0.0, 0, False)
    rows = []
    for pdf in batches:
        # Order within a trigger is that of seq; triggers follow each other.
        for seq, score in pdf.sort_values("seq")[["seq", "score"]].itertuples(index=False):
            v = 0.0 if score is None or math.isnan(score) or math.isinf(score) else float(score)
            step += 1
            velocity = v - b if step >= 2 else 0.0
            acceleration = velocity - (b - c) if step >= 3 else 0.0
            still = step >= 3 and abs(velocity) < VELOCITY_EPSILON and abs(acceleration) < ACCELERATION_EPSILON
            stall = stall + 1 if still else 0
            alarm = stall >= PATIENCE and not alarmed
            alarmed = stall >= PATIENCE
            rows.append((key[0], int(seq), velocity, acceleration, stall, alarm))
            b, c = v, b
    state.update((step, b, c, stall, alarmed))
    yield pd.DataFrame(rows, columns=["series", "seq", "velocity", "acceleration", "stall", "alarm"])


def kinetics_stream(scores: DataFrame) -> DataFrame:
    """A stream (series, seq, score) with velocity, acceleration and stall, and one alarm a plateau.

    Rows of a series have to come in the order of ``seq`` over triggers.
    """
    return scores.groupBy("series").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
