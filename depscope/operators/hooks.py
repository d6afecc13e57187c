"""User functions that run over files or events and return edges, metadata or warnings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from depscope.operators.extract import CLASSIFIED_LANGUAGES, language_of
from depscope.operators.metadata import full_key
from depscope.schemas import EDGE_COLUMNS, HOOK_RESULT

# Fixed value: priority of a hook that names none.
DEFAULT_PRIORITY = 50


def add_edge(source: str, target: str, relation: str) -> dict:
    return {"kind": "add_edge", "path": source, "target": target, "relation": relation}


def set_value(path: str, key: str, value: str) -> dict:
    return {"kind": "set_xattr", "path": path, "key": key, "value": value}


def warning(path: str, message: str) -> dict:
    return {"kind": "warning", "path": path, "message": message}


@dataclass(frozen=True)
class Hook:
    """A function from one row to results; it runs for an event and, if given, some languages."""

    name: str
    on: str
    run: Callable[[dict], list[dict]]
    priority: int = DEFAULT_PRIORITY
    languages: tuple[str, ...] = ()


@dataclass
class HookRegistry:
    hooks: list[Hook] = field(default_factory=list)

    def register(self, name, on, run, priority=DEFAULT_PRIORITY, languages=()) -> Hook:
        hook = Hook(name, on, run, priority, tuple(languages))
        self.hooks.append(hook)
        return hook

    def matching(self, event: str) -> list[tuple[int, Hook]]:
        """Hooks of an event; those of one name run together at their lowest priority."""
        kept = [h for h in self.hooks if h.on == event]
        lowest = {}
        for hook in kept:
            lowest[hook.name] = min(hook.priority, lowest.get(hook.name, hook.priority))
        return sorted(((lowest[h.name], h) for h in kept), key=lambda pair: pair[0])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(h.name, h.on, h.priority, list(h.languages)) for h in self.hooks]
        return spark.createDataFrame(rows, "name string, `on` string, priority int, languages array<string>")


def with_lookups(rows: DataFrame, files: DataFrame | None = None, meta: DataFrame | None = None, keys=()) -> DataFrame:
    """Add what hooks may look up: file content and metadata values, empty where missing."""
    if files is not None:
        rows = rows.join(files.select("path", "content"), "path", "left").fillna("", ["content"])
    if meta is not None and keys:
        from depscope.operators.metadata import metadata_columns

        rows = rows.join(metadata_columns(meta, list(keys)), "path", "left").fillna("", list(keys))
    return rows


def dispatch_hooks(rows: DataFrame, registry: HookRegistry, event: str) -> DataFrame:
    """Results of every hook of an event for every row, in one pass over the rows."""
    matching = registry.matching(event)
    if not matching:
        return rows.sparkSession.createDataFrame([], HOOK_RESULT)
    language = language_of(F.col("path"), CLASSIFIED_LANGUAGES, ignore_case=True)
    tagged = rows.withColumn("language", language)
    if all(hook.languages for _, hook in matching):
        wanted = sorted({name for _, hook in matching for name in hook.languages})
        tagged = tagged.where(F.col("language").isin(*wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for priority, hook in matching:
                    if hook.languages and row["language"] not in hook.languages:
                        continue
                    out += [{"hook": hook.name, "priority": priority, **result} for result in hook.run(row)]
            yield pd.DataFrame(out, columns=HOOK_RESULT.names, dtype=object)

    return tagged.mapInPandas(run, HOOK_RESULT)


def split_hook_results(results: DataFrame, version=0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, metadata, warnings) of hook results."""
    edges = results.where(F.col("kind") == "add_edge").select(
        F.col("path").alias("from"), F.col("target").alias("to"), F.col("relation").alias("rel")
    ).select(*EDGE_COLUMNS)
    meta = results.where(F.col("kind") == "set_xattr").select(
        "path", full_key(F.col("key")).alias("key"), "value", F.lit(version).cast("bigint").alias("version")
    )
    warnings = results.where(F.col("kind") == "warning").select("hook", "path", "message")
    return edges, meta, warnings
