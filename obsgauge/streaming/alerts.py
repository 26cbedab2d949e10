"""Alert state per series: pending → firing → resolved, as a stateful stream.

Input are evaluated steps (rule, series, for_steps, position, active).  The
state of a series is two numbers, kept in the state store.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from obsgauge.session import use_rocksdb

EVENTS = "rule string, series string, event string, active_pos bigint, position bigint"
# Ship the processor itself, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _AlertState(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("alert", "since bigint, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        since, fired = self._state.get() if self._state.exists() else (None, False)
        # Three narrow columns are kept of each chunk; runs of equal verdicts are found by arrays, not step by step.
        chunks = [(c["position"].to_numpy(), c["active"].to_numpy(dtype=bool), c["for_steps"].to_numpy()) for c in rows]
        position, active, hold = (np.concatenate(c) for c in zip(*chunks))
        order = np.argsort(position, kind="stable")
        position, active, hold = position[order], active[order], hold[order]
        starts = np.concatenate([[0], np.flatnonzero(active[1:] != active[:-1]) + 1]) if len(position) else []
        out = []
        for first, last in zip(starts, [*starts[1:], len(position)]):
            if active[first]:
                since = position[first] if since is None else since
                due = position[first:last] - since >= hold[first:last]
                if not fired and due.any():
                    fired = True
                    out.append((*key, "fired", int(since), int(position[first + int(due.argmax())])))
            else:
                if fired:
                    out.append((*key, "resolved", int(since), int(position[first])))
                since, fired = None, False
        if since is None:
            self._state.clear()
        else:
            self._state.update((int(since), bool(fired)))
        if out:
            yield pd.DataFrame(out, columns=["rule", "series", "event", "active_pos", "position"])

    def close(self) -> None:
        pass


def alert_events(steps: DataFrame) -> DataFrame:
    """Fired and resolved events of a stream of evaluated steps (append mode).

    Steps of a series must arrive in order across batches; within a batch they
    are put in order here.
    """
    use_rocksdb(steps.sparkSession)
    return (steps.select("rule", "series", "for_steps", "position", "active").groupBy("rule", "series")
            .transformWithStateInPandas(_AlertState(), EVENTS, "Append", "None"))


def firings_from_events(events: DataFrame) -> DataFrame:
    """Written events paired into firings; ``resolved_pos`` is NULL while one is open."""
    return events.groupBy("rule", "series", "active_pos").agg(
        F.max(F.when(F.col("event") == "fired", F.col("position"))).alias("fired_pos"),
        F.max(F.when(F.col("event") == "resolved", F.col("position"))).alias("resolved_pos"))


