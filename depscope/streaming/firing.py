"""From file events to the actions their triggers call for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from depscope.streaming.events import Trigger, action_rows, match_triggers
from depscope.streaming.stateful import throttle_stream
from depscope.streaming.throttle import throttle

_KEY = ["trigger", "path"]


def fire_triggers(events: DataFrame, triggers: Sequence[Trigger], order: str = "event_id") -> DataFrame:
    """Actions of a table of events (path, event_type, ts): matched, then throttled per trigger and path.

    All triggers share one pass; each row carries its trigger's window.
    """
    return action_rows(throttle(match_triggers(events, triggers), _KEY, "debounce_ms", order))


def fire_triggers_stream(events: DataFrame, triggers: Sequence[Trigger], watermark: str, order: str = "event_id") -> DataFrame:
    """The same actions of a stream, with the window of each trigger."""
    matched = match_triggers(events, triggers).drop("on_success", "on_failure")
    return action_rows(throttle_stream(matched, _KEY, "debounce_ms", watermark, order))
