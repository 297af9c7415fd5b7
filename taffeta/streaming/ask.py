"""T2 on a stream: whether a typed text asks for a completion, with the shown one as each key's state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from taffeta.operators.sessions import _micros, asks

#: Events left waiting that are one value of a key's state.
RUN = 10_000


class Asking(StatefulProcessor):
    """Events wait until the watermark has passed them, then run in order of (time, tie). Each call passes between
    Python and the state store by itself, so the events of a batch wait as one value, with a timer at the earliest;
    a key's earliest waiting event has a timer at its time or before it."""

    def __init__(self, names: list[str]):
        self.names = names  # tie, text, completion

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", T.StructType([T.StructField("completion", T.StringType())]))
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("events", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if batch["event_closes"].any():
                batch = batch[~batch["event_closes"]]
            columns = [[None if v != v else v for v in batch[c].tolist()] for c in (*self.names, "event_us")]
            if columns[-1]:
                self.waiting.appendValue((pickle.dumps(columns),))
                first = min(columns[-1] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((e for run in self.waiting.get() for e in zip(*pickle.loads(run[0]))), key=lambda e: (e[-1], e[0]))
        ready, out = [e for e in events if e[-1] < passed], []
        if ready:
            shown = self.shown.get()[0] if self.shown.exists() else None
            for tie, text, completion, _ in ready:
                request = asks(shown, text)
                shown = completion if request else shown
                out.append((tie, text, completion, request))
            self.shown.update((shown,))
            rest = events[len(ready):]
            if rest:
                self.waiting.put([(pickle.dumps(list(zip(*rest[i:i + RUN]))),) for i in range(0, len(rest), RUN)])
            else:
                self.waiting.clear()
        if len(ready) < len(events):
            self.handle.registerTimer(events[len(ready)][-1] // 1000)
        if out:
            yield pd.DataFrame(out, columns=[*self.names, "request"])

    def close(self) -> None:
        pass


def changed_prefix_stream(events: DataFrame, key: str, ts_col: str, tie: str, text_col: str, completion_col: str,
                          watermark: str = "10 seconds") -> DataFrame:
    """(tie, text, completion, request) of each event, as ``operators.sessions.changed_prefix`` tells it, from a
    stream whose events may come as late as ``watermark``. Rows without a tie are closing rows. Start it
    inside ``state.rocksdb``."""
    names = [tie, text_col, completion_col]
    d = events.withColumn("event_us", _micros(ts_col)).withColumn("event_ts", F.timestamp_micros("event_us")).withWatermark("event_ts", watermark)
    out = T.StructType([*(events.schema[c] for c in names), T.StructField("request", T.BooleanType())])
    # pandas would turn whole numbers beside a null into floats
    d = d.withColumn("event_closes", F.col(tie).isNull()).withColumn(tie, F.coalesce(tie, F.lit(0).cast(events.schema[tie].dataType)))
    # state must not be kept under a null key
    group = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    d = d.select(group.alias("event_key"), *names, "event_us", "event_ts", "event_closes")
    return d.groupBy("event_key").transformWithStateInPandas(Asking(names), out, "Append", "EventTime")
