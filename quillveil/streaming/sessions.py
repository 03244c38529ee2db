"""Pseudonymization of turns as they arrive, with one mapping a session in the state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators import sessions
from ..operators.detection import Finder
from .fragments import Ordered

OUTPUT = T.StructType([T.StructField("session", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("text", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error_class", T.StringType())])
STATE = T.StructType([T.StructField("mapping", T.StringType()), T.StructField("next", T.LongType()), T.StructField("waiting", T.StringType())])


def mask_stream(turns: DataFrame, idle_seconds: int = sessions.IDLE_SECONDS, most: int = sessions.MOST_VALUES) -> DataFrame:
    """(session, turn, text, status, error_class) of a streaming table (session string, turn long from 0, text).

    Turns ahead of their predecessors wait in the state, a bounded number and size of them.  Beyond that, or when the session has been idle for idle_seconds, those
    that are missing are given up: one refused row tells of each gap (turn_missing), the turns behind it go on with the mapping as it is, and a
    missing turn that comes later is ignored.  An idle session then loses its mapping.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        find, rows, late = Finder(), [], state.hasTimedOut
        mapping, line = sessions.Mapping(most), Ordered()
        if state.exists:
            dumped, at, waiting = state.get
            mapping, line = sessions.Mapping.load(dumped), Ordered({"next": at, "waiting": json.loads(waiting)})
        for pdf in () if late else frames:
            for n, text in zip(pdf["turn"], pdf["text"], strict=True):
                line.add(int(n), [text])
        while True:
            for n, (text,) in line.take():
                mapping, masked, error = sessions.turn(mapping, text, find)
                rows.append((key[0], n, masked, "refused" if error else "completed", error))
            if not line.over and not (late and line.waiting):
                break
            rows.append((key[0], line.next, None, "refused", "turn_missing"))
            line.next = min(map(int, line.waiting))
        if late:
            state.remove()
        else:
            state.update((mapping.dump(), line.next, json.dumps(line.waiting)))
            state.setTimeoutDuration(idle_seconds * 1000)
        if rows:
            yield pd.DataFrame(rows, columns=OUTPUT.names)

    return turns.groupBy("session").applyInPandasWithState(run, OUTPUT, STATE, "append", "ProcessingTimeTimeout")
