"""File events and the triggers they fire."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depscope.functions.paths import file_name, render_template
from depscope.operators.metadata import full_key

# Event bits of the kernel's file watch interface.
CLOSE_WRITE, CREATE, DELETE, DELETE_SELF = 0x8, 0x100, 0x200, 0x400
# Settings a trigger has unless told otherwise.
DEFAULT_EVENTS = ("write", "delete")
DEFAULT_TIMEOUT_SECONDS, DEFAULT_DEBOUNCE_MS = 30, 500


@dataclass(frozen=True)
class TriggerAction:
    """set_xattr with a key and a value template, warn, or error."""

    kind: str
    key: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class Trigger:
    name: str
    pattern: str = "*"
    events: tuple[str, ...] = DEFAULT_EVENTS
    command: str | None = None
    builtin: str | None = None
    async_exec: bool = True
    timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS
    debounce_ms: int = DEFAULT_DEBOUNCE_MS
    on_success: TriggerAction | None = None
    on_failure: TriggerAction | None = None


_TRIGGER = (
    "trigger string, pattern string, events array<string>, command string, builtin string, async_exec boolean, "
    "timeout_seconds int, debounce_ms bigint, on_success struct<kind:string,key:string,value:string>, "
    "on_failure struct<kind:string,key:string,value:string>"
)


def triggers_table(spark: SparkSession, triggers: Sequence[Trigger]) -> DataFrame:
    action = lambda a: None if a is None else (a.kind, a.key, a.value)
    rows = [
        (t.name, t.pattern, list(t.events), t.command, t.builtin, t.async_exec, t.timeout_seconds, t.debounce_ms,
         action(t.on_success), action(t.on_failure))
        for t in triggers
    ]
    return spark.createDataFrame(rows, _TRIGGER)


def event_type(mask: Column) -> Column:
    """write, delete or create of an event mask, else null; earlier kinds win."""
    has = lambda bits: mask.bitwiseAND(F.lit(bits)) != 0
    return F.when(has(CLOSE_WRITE), "write").when(has(DELETE | DELETE_SELF), "delete").when(has(CREATE), "create")


def typed_events(raw: DataFrame) -> DataFrame:
    """Raw events (path, mask, ts) with their kind; other kinds are dropped."""
    return raw.withColumn("event_type", event_type(F.col("mask"))).where("event_type is not null").drop("mask")


def matches_pattern(path: Column, pattern: str) -> Column:
    """`*` takes all, `*suffix` the ends, anything else the whole file name."""
    if pattern == "*":
        return F.lit(True)
    return file_name(path).endswith(pattern[1:]) if pattern.startswith("*") else file_name(path) == pattern


def match_triggers(events: DataFrame, triggers: Sequence[Trigger]) -> DataFrame:
    """A row per event and matching trigger, for tables and streams.

    Pattern and event kind together are the key of an equi join: an event is
    looked up as any file, by its name, and by its endings of the lengths that
    occur in the patterns. The triggers are broadcast: they come from the caller
    as a sequence, so their side never grows, while Spark knows no size of it and
    would else send the events to every executor, or all `any` rows to one task.
    """
    spark = events.sparkSession
    table = triggers_table(spark, triggers)
    pattern = F.col("pattern")
    key = (
        F.when(pattern == "*", "any").when(pattern.startswith("*"), F.concat(F.lit("end:"), F.substring(pattern, F.lit(2), F.length(pattern))))
        .otherwise(F.concat(F.lit("name:"), pattern))
    )
    table = table.withColumn("_key", key).withColumn("_kind", F.explode(F.array_distinct("events"))).drop("events")
    lengths = sorted({len(t.pattern) - 1 for t in triggers if t.pattern.startswith("*") and t.pattern != "*"})
    name = file_name(F.col("path"))
    endings = [
        F.when(F.length(name) >= n, F.concat(F.lit("end:"), F.substring(name, F.length(name) - n + 1, F.lit(n)))) for n in lengths
    ]
    keys = F.array_distinct(F.array_compact(F.array(F.lit("any"), F.concat(F.lit("name:"), name), *endings)))
    return (
        events.withColumn("_event_key", F.explode(keys))
        .join(F.broadcast(table), (F.col("_event_key") == F.col("_key")) & (F.col("event_type") == F.col("_kind")))
        .drop("_key", "_event_key", "_kind")
    )


def action_rows(fired: DataFrame) -> DataFrame:
    """What a runner has to do: (trigger, path, event_type, ts, action, command, async_exec, timeout_seconds)."""
    action = F.when(F.col("builtin").isNotNull(), "builtin").when(F.col("command").isNotNull(), "command").otherwise("none")
    command = F.when(F.col("builtin").isNotNull(), F.col("builtin")).otherwise(render_template(F.col("command"), F.col("path")))
    return fired.select(
        "trigger", "path", "event_type", "ts", action.alias("action"), command.alias("command"), "async_exec", "timeout_seconds"
    )


def action_outcomes(outcomes: DataFrame, triggers: Sequence[Trigger]) -> DataFrame:
    """(trigger, path, kind, key, value) that outcomes (trigger, path, success) call for."""
    table = triggers_table(outcomes.sparkSession, triggers)
    actions = table.select("trigger", F.explode(F.map_from_arrays(
        F.array(F.lit(True), F.lit(False)), F.array("on_success", "on_failure")
    )).alias("success", "action")).where(F.col("action").isNotNull())
    value = F.when(F.col("action.kind") == "set_xattr", render_template(F.col("action.value"), F.col("path")))
    return outcomes.join(F.broadcast(actions), ["trigger", "success"]).select(
        "trigger", "path", F.col("action.kind").alias("kind"), full_key(F.col("action.key")).alias("key"), value.alias("value")
    )


def action_metadata(outcomes: DataFrame, triggers: Sequence[Trigger], version) -> DataFrame:
    """The metadata updates among the outcomes of triggers."""
    return action_outcomes(outcomes, triggers).where(F.col("kind") == "set_xattr").select(
        "path", "key", "value", F.lit(version).cast("bigint").alias("version")
    )
