"""Leading-edge throttling of a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from depscope.streaming.throttle import firing_times

# Events that one entry of the state holds at most.
ENTRY_ROWS = 4096


class ThrottleProcessor(StatefulProcessor):
    """Holds events of a key until the watermark has passed them, then fires in event order.

    Waiting makes the result independent of the order in which files or messages
    arrive: it equals the throttle of the same events as a table.

    Held events are entries of a map by their first and last time and a number that tells equal ones
    apart. An entry has the events of a key that came together, so that the calls to the state store
    follow the entries and not the events. It is written once, and removed once all of it has passed;
    what fired or was left out of it before then is known by the time up to which the key is done. Values
    stay Python objects all along, so whole numbers beside nulls keep every digit.
    """

    def __init__(self, columns, held, window_ms, order):
        self.columns, self.held = columns, held
        self.window_ms, self.order = window_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long = lambda name: T.StructField(name, T.LongType())
        self.last = handle.getValueState("last", T.StructType([long("fired"), long("done")]))
        self.waiting = handle.getMapState(
            "waiting", T.StructType([long("first"), long("last"), long("number")]), T.StructType([T.StructField("rows", T.ArrayType(self.held))]))
        self.at_order = self.held.names.index(self.order)
        self.at_window = self.held.names.index(self.window_ms) if isinstance(self.window_ms, str) else None
        self.row = Row(*self.columns)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # An event without a time never fires.
        timed, earliest = (tuple(row[n] for n in self.held.names) for row in rows if row["event_micros"] is not None), None
        while entry := sorted(islice(timed, ENTRY_ROWS), key=lambda r: r[0]):
            first, last, number = entry[0][0], entry[-1][0], 0
            while self.waiting.containsKey((first, last, number)):
                number += 1
            self.waiting.updateValue((first, last, number), (entry,))
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake_after(earliest)
        return iter(())

    def _wake_after(self, micros: int) -> None:
        self.handle.registerTimer((micros + 999) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # No row up to the watermark can still arrive.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        last, done = self.last.get() if self.last.exists() else (None, None)
        if done is not None and done >= until:
            return
        ready, later = [], []
        for entry in [tuple(p) for p in self.waiting.keys()]:
            if entry[0] > until:
                later.append(entry[0])
                continue
            for row in self.waiting.getValue(entry)[0]:
                if row[0] > until:
                    later.append(row[0])
                elif done is None or row[0] > done:
                    ready.append(row)
            if entry[1] <= until:
                self.waiting.removeKey(entry)
        if later:
            self._wake_after(min(later))
        order = self.at_order
        ready.sort(key=lambda r: (r[0], r[order] is None, r[order] if r[order] is not None else 0))
        if ready:
            window = self.window_ms if self.at_window is None else int(ready[0][self.at_window])
            times = np.array([r[0] for r in ready], dtype=np.int64)
            fired, now = firing_times(times, last, window * 1000) if window > 0 else (range(len(ready)), None)
            last = now if now is not None else last
        self.last.update((last, until))
        if ready:
            for i in fired:
                yield self.row(*key, *ready[i])

    def close(self) -> None:
        pass


def throttle_stream(
    events: DataFrame, keys: Sequence[str], window_ms: int | str, watermark: str, order: str = "event_id", ts: str = "ts"
) -> DataFrame:
    """The events of a stream that fire, in append mode; events later than the watermark are dropped.

    The window is a number, or a column that has one value per key.
    `ts` comes back in microseconds since the epoch turned into a timestamp. Needs
    the RocksDB state store.
    """
    # The worker hands rows over as named tuples, which cannot have names that start with `_`.
    timed = events.withWatermark(ts, watermark).withColumn("event_micros", F.unix_micros(ts))
    payload = [n for n in events.columns if n not in keys and n != ts]
    held = T.StructType([T.StructField("event_micros", T.LongType()), *[T.StructField(n, events.schema[n].dataType) for n in payload]])
    out = T.StructType([T.StructField(n, events.schema[n].dataType) for n in keys] + held.fields)
    fired = timed.groupBy(*keys).transformWithState(
        statefulProcessor=ThrottleProcessor(out.names, held, window_ms, order),
        outputStructType=out, outputMode="Append", timeMode="EventTime",
    )
    return fired.withColumn(ts, F.timestamp_micros("event_micros")).select(*events.columns)
