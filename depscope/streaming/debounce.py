"""Trailing debounce: one firing after a key has been quiet for a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def debounce_trailing(events: DataFrame, keys: Sequence[str], gap_ms: int, ts: str = "ts") -> DataFrame:
    """Bursts of a table: (keys, first_ts, last_ts, n_events). A quiet time longer than `gap_ms` ends one.

    Events of a key in one slot of the length of the gap always belong together.
    They are merged before the shuffle, so the window below sees at most one row
    per key and slot however many events there are.
    """
    gap = gap_ms * 1000
    timed = events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    slots = timed.groupBy(*keys, F.floor(F.col("_t") / gap).alias("_slot")).agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("*").alias("_n")
    )
    in_order = Window.partitionBy(*keys).orderBy("_slot")
    starts = F.coalesce((F.col("_lo") - F.lag("_hi").over(in_order) > gap).cast("int"), F.lit(1))
    burst = F.sum("_starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        slots.withColumn("_starts", starts).withColumn("_burst", burst).groupBy(*keys, "_burst")
        .agg(
            F.timestamp_micros(F.min("_lo")).alias("first_ts"), F.timestamp_micros(F.max("_hi")).alias("last_ts"),
            F.sum("_n").alias("n_events"),
        ).drop("_burst")
    )


def debounce_stream(events: DataFrame, keys: Sequence[str], gap_ms: int, watermark: str, ts: str = "ts") -> DataFrame:
    """The same bursts of a stream, each once the watermark has passed its quiet gap."""
    gap = f"{gap_ms} milliseconds"
    return (
        events.withWatermark(ts, watermark).groupBy(*keys, F.session_window(ts, gap).alias("_burst"))
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))
        .drop("_burst")
    )
