"""Leading-edge throttling of events.

An event fires unless an event of the same key fired less than a window before
it; events that did not fire do not extend the window. The rule is sequential
within a key, yet a key with very many events must not be one task:

* The timeline of such a hot key is cut into segments. Each segment is read once
  to learn what it does to a last firing time that comes in: a short table of
  (entry up to, exit), since histories that differ at its start soon agree.
* The tables of one hot key, a few rows per segment, are chained in order, which
  gives the incoming time of every segment.
* All segments then fire their events independently of each other.

Other keys are one segment each and take part in the last step only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

# A key with more events than this is cut into segments of about this many.
SEGMENT_ROWS = 200_000
# A segment spans at least this many windows, so that its table stays short.
MIN_WINDOWS = 16


def throttle(
    events: DataFrame, keys: Sequence[str], window_ms: int | str, order: str = "event_id", ts: str = "ts",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The events that fire. Events of one key at one time are taken in `order`.

    The window is a number, or a column that has one value per key. Null keys are keys like others;
    an event without a time never fires; a window of 0 or less lets every event with a time fire.
    """
    columns = events.columns
    width = F.col(window_ms) if isinstance(window_ms, str) else F.lit(window_ms)
    # One text stands for all keys, so that a null equals a null and no number changes its type on the way.
    timed = events.where(F.col(ts).isNotNull()).select(
        *columns, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), (width.cast("bigint") * 1000).alias("_w"),
        F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"),
    )
    open_ = timed.where(F.coalesce("_w", F.lit(0)) <= 0).select(*columns)
    timed = timed.where(F.col("_w") > 0)

    # Only keys above the threshold are joined back: at most rows / segment_rows of them.
    spans = (
        timed.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.max("_w").alias("_wide"))
        .where(F.col("_n") > segment_rows)
        .select(
            "_key", "_lo",
            F.greatest(
                F.col("_wide") * MIN_WINDOWS, F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / segment_rows))
            ).cast("bigint").alias("_span"),
        )
    )
    segment = F.expr("(_t - _lo) div _span")
    cut = timed.join(spans, "_key", "left").select(
        *columns, "_t", "_w", "_key", F.coalesce(segment, F.lit(-1)).cast("bigint").alias("_segment")
    )
    group = ["_key", "_segment"]

    # Times of the hot keys only.
    hot = timed.select("_key", "_t", "_w").join(spans, "_key").select("_key", segment.alias("_segment"), "_t", "_w")
    tables = _sorted(hot, group, ["_t"])
    tables = tables.mapInPandas(_segment_tables(group), _schema(cut, group, ["_w", "entry", "exit"]))
    # Per hot key: a few rows per segment, whatever the number of its events.
    entries = tables.groupBy("_key").applyInPandas(_chain, _schema(cut, group, ["_last"]))

    ready = cut.join(entries, group, "left")
    fired = _sorted(ready, group, ["_t", order])
    return fired.mapInArrow(_fire(columns), T.StructType(_fields(cut, columns))).unionByName(open_)


def _fields(df: DataFrame, names) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _schema(df: DataFrame, group, longs) -> T.StructType:
    return T.StructType(_fields(df, group) + [T.StructField(n, T.LongType()) for n in longs])


def _sorted(df: DataFrame, group, then) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, *then)


def _runs(batch: pd.DataFrame, group) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, end) of consecutive rows with the same key."""
    if batch.empty:
        return
    changed = np.zeros(len(batch), dtype=bool)
    for name in group:
        values = batch[name].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    starts = np.flatnonzero(changed).tolist()
    starts.insert(0, 0)
    heads = batch[group].iloc[starts].itertuples(index=False, name=None)
    for key, start, end in zip(heads, starts, starts[1:] + [len(batch)]):
        yield key, start, end


def firing_times(times: np.ndarray, last: int | None, window: int) -> tuple[list[int], int | None]:
    """Positions in sorted times that fire after an earlier firing, and the last firing time."""
    fired, at = [], 0 if last is None else int(np.searchsorted(times, last + window))
    while at < len(times):
        fired.append(at)
        last = int(times[at])
        at = at + int(np.searchsorted(times[at:], last + window))
    return fired, last


def _fire(columns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            times, widths, entered = (batch.column(c) for c in ("_t", "_w", "_last"))
            times, kept = times.to_numpy(), []
            changed = np.zeros(batch.num_rows, dtype=bool)
            for name in ("_key", "_segment"):
                values = batch.column(name)
                changed[1:] |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(changed).tolist()]
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                key = (batch.column("_key")[start].as_py(), batch.column("_segment")[start].as_py())
                if key != current:
                    current, last = key, entered[start].as_py()
                fired, last = firing_times(times[start:end], last, widths[start].as_py())
                kept += [start + i for i in fired]
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    return run


class SegmentTable:
    """What a segment does to the firing time that comes in.

    An incoming time lets the segment start at the first event that is a window
    later, which is an event of the first window or the one after it. All these
    starts are followed at once. Paths that fire at the same event are one path
    from then on, so few remain. Times may arrive in several sorted parts.
    """

    def __init__(self, window: int):
        self.window = window
        self.limit = None
        self.open = True
        # (last firing time, starts that led to it), oldest last time first.
        self.paths: deque[tuple[int, list[int]]] = deque()

    def add(self, times: np.ndarray) -> None:
        if self.limit is None:
            self.limit = int(times[0]) + self.window
        times, at = np.unique(times), 0
        while at < len(times):
            if not self.open:
                # Nothing happens before the oldest path may fire again.
                at += int(np.searchsorted(times[at:], self.paths[0][0] + self.window))
                if at == len(times):
                    return
            now, starts = int(times[at]), []
            while self.paths and self.paths[0][0] + self.window <= now:
                starts += self.paths.popleft()[1]
            if self.open:
                starts.append(now)
                self.open = now < self.limit
            if starts:
                self.paths.append((now, starts))
            at += 1

    def rows(self) -> list[tuple[int, int]]:
        """(largest start, exit) of neighbouring starts with the same exit, in order."""
        pairs = sorted((start, last) for last, starts in self.paths for start in starts)
        return [p for p, after in zip(pairs, pairs[1:] + [(None, None)]) if p[1] != after[1]]


def _segment_tables(group):
    columns = [*group, "_w", "entry", "exit"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, table = None, None
        for batch in batches:
            times, rows = batch["_t"].to_numpy(), []
            for key, start, end in _runs(batch, group):
                if key != current:
                    if table is not None:
                        rows += [(*current, table.window, *row) for row in table.rows()]
                    current, table = key, SegmentTable(int(batch["_w"].iat[start]))
                table.add(times[start:end])
            if rows:
                yield pd.DataFrame(rows, columns=columns, dtype=object)
        if table is not None:
            yield pd.DataFrame([(*current, table.window, *row) for row in table.rows()], columns=columns, dtype=object)

    return run


def _chain(tables: pd.DataFrame) -> pd.DataFrame:
    """The firing time that comes into each segment of one key."""
    tables = tables.sort_values(["_segment", "entry"])
    window = int(tables["_w"].iat[0])
    segments, entries, exits = (tables[c].to_numpy() for c in ("_segment", "entry", "exit"))
    starts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]])
    last, incoming = None, []
    for start, end in zip(starts, [*starts[1:], len(tables)]):
        incoming.append(last)
        at = start if last is None else start + int(np.searchsorted(entries[start:end], last + window))
        if at < end:
            last = int(exits[at])
    return pd.DataFrame({"_key": tables["_key"].iat[0], "_segment": segments[starts], "_last": pd.array(incoming, dtype="Int64")})
