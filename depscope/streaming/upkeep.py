"""Keeping an edge table current as files change.

The store is append-only. Every batch of file events writes one folder per table,
named by the store's generation and the batch id: writing it again replaces it, so
a repeated batch changes nothing. The current edges of a file are those of the
newest (generation, batch) that touched it; a deleted file has none.

A file's edges are kept in two parts that change at different times: its imports,
when its text changes, and its test edges, when it or a file that it may test or be
tested by appears or goes.

`compact` writes the current state as the base of a new generation and then marks
that generation, which is one atomic step; readers see the old state until then. A
batch that is repeated after it adds to the new generation and never touches the
base. A stream that starts without its old checkpoint counts its batches from 0, so
it starts a generation too. Changes, metadata and impact are history and stay.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from depscope import scratch
from depscope.operators.associate import flag_external, partners, test_associations
from depscope.operators.extract import extract_imports
from depscope.operators.graph import edge_changes
from depscope.operators.metadata import KEY_PREFIX
from depscope.operators.targets import resolved_edges
from depscope.plans.traverse import DEFAULT_DEPTH, walk
from depscope.schemas import EDGE, EDGE_COLUMNS, METADATA

_PLACE = [T.StructField("generation", T.IntegerType()), T.StructField("batch", T.LongType())]
_PART = T.StructField("part", T.StringType())
_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("deleted", T.BooleanType()), _PART, *_PLACE])
_EDGES = T.StructType([*EDGE.fields, _PART, *_PLACE])
_CHANGES = T.StructType([*EDGE.fields, T.StructField("change", T.StringType()), *_PLACE])
_IMPACTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("depth", T.IntegerType()), *_PLACE])
_METADATA = T.StructType([*METADATA.fields, *_PLACE])
IMPORTS, TESTS = _PARTS = "imports", "tests"
_BASE = -1


# Places and versions are numbers, and most aggregates are maxima of numbers, so that groups are hashed and not sorted.
def _number(generation: int, batch: int) -> int:
    return (generation << 32) + batch


def _place() -> Column:
    return F.shiftleft(F.col("generation").cast("bigint"), 32) + F.col("batch")


def _version() -> Column:
    return (2 * _place() + F.when(F.col("deleted") == F.lit(False), 0).otherwise(1)).alias("version")


def _live(version: str) -> Column:
    return F.col(version).bitwiseAND(1) == 0


def _newest(condition: Column) -> list[Column]:
    return [F.max(F.when(condition & (F.col("part") == part), F.col("_place"))).alias(f"_{part}") for part in _PARTS]


def _of_part(table: str | None = None, suffix: str = "") -> Column:
    """Of a file's columns per part the one of an edge's part."""
    imports, tests = (F.col(f"{table + '.' if table else ''}_{part}{suffix}") for part in _PARTS)
    return F.when(F.col("part") == IMPORTS, imports).otherwise(tests)


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, without a Python worker that would make them."""
    return spark.range(0).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in schema])


class EdgeStore:
    """An edge table below a folder that every executor can reach. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _marks(self) -> list[str]:
        store, path = self._at("generations")
        return [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []

    def generation(self) -> int:
        return max((int(m.removesuffix("-base")) for m in self._marks()), default=0)

    def _first(self) -> int:
        """The newest generation with a base: nothing older counts for the current edges."""
        return max((int(m.removesuffix("-base")) for m in self._marks() if m.endswith("-base")), default=0)

    def _mark(self, name: str) -> None:
        store, path = self._at(f"generations/{name}")
        store.create(path, False).close()

    def begin(self) -> None:
        """Start a generation, for a writer that counts its batches anew."""
        self._mark(str(self.generation() + 1))

    def _read(self, table: str, schema: T.StructType, before: int | None = None, whole: bool = True) -> DataFrame:
        store, path = self._at(table)
        if not store.exists(path):
            return _empty(self.spark, schema)
        now = self.generation()
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}").where(F.col("generation") <= now)
        if not whole:
            rows = rows.where(F.col("generation") >= self._first())
        return rows if before is None else rows.where((F.col("generation") < now) | (F.col("batch") < before))

    def write(self, table: str, rows: DataFrame, batch: int, generation: int | None = None) -> DataFrame:
        now = self.generation() if generation is None else generation
        target = f"{self.folder}/{table}/generation={now}/batch={batch}"
        rows.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target)

    def _places(self, before: int | None) -> list[tuple[int, int]]:
        """(generation, batch) of the written batches that count, oldest first."""
        store, path = self._at("files/generation=*/batch=*")
        found = [s.getPath() for s in store.globStatus(path) or []]
        number = lambda folder: int(folder.getName().partition("=")[2])
        places = {(number(f.getParent()), number(f)): f for f in found}
        now, first = self.generation(), self._first()
        kept = sorted((g, b) for g, b in places if first <= g <= now and (before is None or g < now or b < before))
        # A batch that broke off before its files were written does not count.
        written = lambda place: any(s.getPath().getName()[0] not in "._" for s in store.listStatus(places[place]))
        while kept and not written(kept[-1]):
            kept.pop()
        return kept

    def has_batches(self, before: int | None = None, after: int | None = None) -> bool:
        """Whether batches count that lie before one of this generation, or after it."""
        return any(after is None or place > (self.generation(), after) for place in self._places(before))

    def versions(self, before: int | None = None) -> DataFrame:
        """(path, part, version) of the files and their parts as batches wrote them; the greatest version of a part counts, and `_live` tells it."""
        return self._read("files", _FILES, before, False).select("path", "part", _version())

    def raw_edges(self, before: int | None = None) -> DataFrame:
        """Edges with their part and place, also those that a later batch has replaced."""
        places = self._places(before)
        rows = self._read("edges", _EDGES, before, False)
        generation, batch = places[-1] if places else (0, _BASE - 1)
        return rows.where((F.col("generation") < generation) | ((F.col("generation") == generation) & (F.col("batch") <= batch)))

    def current(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Of edges with their part and place those that no later batch has replaced."""
        places = self._places(before)
        if len(places) < 2:
            return rows
        later = self._later(places, before).groupBy("path").agg(*_newest(F.lit(True)))
        rows = rows.withColumn("_place", _place())
        return rows.alias("e").join(later.alias("l"), (F.col("e.from") == F.col("l.path")) & (F.col("e._place") < _of_part("l")), "left_anti").drop("_place")

    def _later(self, places: list[tuple[int, int]], before: int | None) -> DataFrame:
        """(path, part, _place) of the files of all places but the oldest: that one has replaced nothing."""
        files = self._read("files", _FILES, before, False).where((F.col("generation") != places[0][0]) | (F.col("batch") != places[0][1]))
        return files.select("path", "part", _place().alias("_place"))

    def _live(self, before: int | None) -> DataFrame:
        places, rows = self._places(before), self.raw_edges(before)
        if len(places) > 1:
            newest = (F.col("generation") == places[-1][0]) & (F.col("batch") == places[-1][1])
            rows = rows.where(newest).unionByName(self.current(rows.where(~newest), before))
        return rows.select(*EDGE_COLUMNS, "part")

    def edges(self, before: int | None = None) -> DataFrame:
        """The current edges, or those before a batch of this generation."""
        return self._live(before).select(*EDGE_COLUMNS)

    def difference(self, batch: int) -> DataFrame:
        """What a written batch of this generation, not the first, added to the edges of what it touched, and removed from them.

        Edges meet one row per file, which says what the batch touched and what was newest before. They are shuffled once.
        """
        at = F.lit(_number(self.generation(), batch))
        ends = self._later(self._places(batch + 1), batch + 1).groupBy(F.col("path").alias("from")).agg(
            *_newest(F.col("_place") < at), *[F.max((F.col("part") == part) & (F.col("_place") == at)).alias(f"_{part}_touched") for part in _PARTS])
        ends = ends.where(F.greatest(*[F.col(f"_{part}_touched") for part in _PARTS]))
        rows = self.raw_edges(batch + 1).withColumn("_place", _place()).join(ends, "from")
        rows = rows.where(_of_part(None, "_touched") & (F.col("_place") >= F.coalesce(_of_part(), "_place")))
        # A relation belongs to one part, so an edge is in one part at most.
        return edge_changes(rows.select(*EDGE_COLUMNS, F.when(F.col("_place") == at, 2).otherwise(1).alias("_side")))

    def changes(self) -> DataFrame:
        return self._read("changes", _CHANGES)

    def impacted(self) -> DataFrame:
        return self._read("impacted", _IMPACTED)

    def metadata(self) -> DataFrame:
        return self._read("metadata", _METADATA)

    def compact(self) -> EdgeStore:
        """Fold the current state into the base of a new generation."""
        versions, after = self.versions().groupBy("path", "part").agg(F.max("version").alias("version")), self.generation() + 1
        self.write("files", versions.where(_live("version")).select("path", F.lit(False).alias("deleted"), "part"), _BASE, after)
        self.write("edges", self._live(None), _BASE, after)
        self._mark(f"{after}-base")
        return self


def net_changes(events: DataFrame) -> DataFrame:
    """The last event of each path in a batch: (path, deleted, ts)."""
    # Of one time a delete comes last, and an event of no type first. Maxima of plain values, so that paths are hashed and not sorted.
    deleted = F.col("event_type") == "delete"
    last = events.groupBy("path").agg(
        F.max("ts").alias("ts"), F.max(deleted).alias("_any"), F.max(F.when(deleted, F.col("ts"))).alias("_gone"), F.max(F.when(~deleted, F.col("ts"))).alias("_there"))
    timed = F.when(F.col("_gone") == F.col("ts"), True).when(F.col("_there") == F.col("ts"), False)
    return last.select("path", F.when(F.col("ts").isNull(), F.col("_any")).otherwise(timed).alias("deleted"), "ts")


def there_after(store: EdgeStore, changed: DataFrame, batch: int) -> DataFrame:
    """(path, paired) of the files there are after a batch that is not the first: paired are those of the batch, and those paired with one of it by name.

    What was stored, what the batch touched and whose names it may pair meet in one aggregate.
    """
    none = lambda kind: F.lit(None).cast(kind)
    stored = store.versions(before=batch).where(F.col("part") == IMPORTS).select("path", "version", none("int").alias("kind"), none("boolean").alias("named"))
    kind = F.when(F.col("deleted") == F.lit(False), 1).otherwise(2)
    touched = changed.select("path", none("bigint"), kind, none("boolean"))
    named = partners(changed).select("path", none("bigint"), none("int"), F.lit(True))
    rows = stored.union(touched).union(named).groupBy("path").agg(*[F.max(c).alias(c) for c in ("version", "kind", "named")])
    present, other = F.coalesce(F.col("kind") == 1, F.lit(False)), F.col("kind").isNull() & _live("version")
    return rows.where(present | other).select("path", (present | F.coalesce("named", F.lit(False))).alias("paired"))


# How targets begin that are no paths.
_PREFIXES = ("local:", "pkg:", "std:", "sys:")


def impact_of(store: EdgeStore, files: DataFrame, changed: DataFrame, batch: int, max_depth: int) -> DataFrame:
    """(path, relation, depth) of files that depend on a changed one: one walk from all of them, nearest depth each.

    Targets that mean a file count as that file. Only edges that can lead on are walked: their targets are
    files or changed paths, and their sources have not changed. Imports that the batch wrote have changed sources.
    """
    written = (F.col("generation") == store.generation()) & (F.col("batch") == batch)
    edges = store.raw_edges().where(~written | (F.col("part") != IMPORTS))
    prefixed = functools.reduce(Column.__or__, [F.col("to").startswith(p) for p in _PREFIXES])
    # Files are hardly ever named like targets with a prefix: then this is empty, and sent to the edges.
    odd = files.union(changed.select("path")).withColumnRenamed("path", "to").where(prefixed).distinct()
    odd = scratch.materialize(odd, "odd")
    hops = edges.where(~prefixed).unionByName(edges.where(prefixed).join(odd, "to", "left_semi").select(*edges.columns))
    hops = store.current(hops.unionByName(resolved_edges(edges, files)))
    hops = hops.join(changed.select(F.col("path").alias("from")), "from", "left_anti").select(*EDGE_COLUMNS)
    known = scratch.materialize(hops, "known")
    starts = changed.select("path").join(known.select(F.col("to").alias("path")), "path", "left_semi")
    rows = walk(known, starts.select(F.lit("changed").alias("root"), "path"), max_depth).rows
    return rows.select("path", "relation", "depth")


def apply_batch(
    store: EdgeStore, events: DataFrame, batch: int, load_files: Callable[[DataFrame], DataFrame],
    max_depth: int = DEFAULT_DEPTH, mounts: DataFrame | None = None,
) -> None:
    """Bring the store up to date with one batch of events (path, event_type, ts).

    `load_files` turns changed paths into (path, content) rows. Outgoing edges of
    a deleted file go; imports of other files that name it stay.
    """
    flagged = lambda edges: edges if mounts is None else flag_external(edges, mounts)
    # In order, names that begin alike lie together: they are stored and shuffled in fewer bytes.
    changed = store.write("touched", net_changes(events).sortWithinPartitions("path"), batch)
    gone, present = changed.where("deleted").select("path"), changed.where("NOT deleted").select("path")
    first = not store.has_batches(before=batch)
    there, paired = present, present
    if not first:
        # Whose test edges may differ now: the files of the batch and those paired with one of them by name.
        state = store.write("there", there_after(store, changed, batch).sortWithinPartitions("path"), batch)
        there, paired = state.select("path"), state.where("paired").select("path")

    # A loader may give more than was asked for, and a path several times.
    loaded = load_files(present).join(present, "path", "left_semi")
    imports = flagged(extract_imports(loaded)).distinct().withColumn("part", F.lit(IMPORTS))
    tests = flagged(test_associations(paired, there))
    tests = (tests if mounts is None else tests.distinct()).withColumn("part", F.lit(TESTS))
    edges = store.write("edges", imports.unionByName(tests), batch)
    versions = (
        changed.select("path", "deleted", F.lit(IMPORTS).alias("part"))
        .union(gone.select("path", F.lit(True), F.lit(TESTS))).union(paired.select("path", F.lit(False), F.lit(TESTS)))
    )
    store.write("files", versions, batch)
    new = edges.select(*EDGE_COLUMNS)
    # With nothing before it, a batch adds all of its edges; while it is alone, no file is there that has not changed.
    changes = new.withColumn("change", F.lit("added")) if first else store.difference(batch)
    store.write("changes", changes, batch)

    if first and not store.has_batches(after=batch):
        reached = _empty(changed.sparkSession, _IMPACTED).drop("generation", "batch")
    else:
        reached = impact_of(store, there, changed, batch, max_depth)
    impacted = store.write("impacted", reached, batch)
    said = lambda rows, key, value: rows.select(
        "path", F.lit(KEY_PREFIX + key).alias("key"), value.alias("value"),
        F.lit((store.generation() << 32) + batch).cast("bigint").alias("version"))
    kind = F.concat(F.when(F.col("depth") == 1, "direct").otherwise("indirect"), F.lit(":"), F.col("depth"))
    store.write("metadata", said(changed.where("NOT deleted"), "last_modified", F.col("ts").cast("string")).union(said(impacted, "impact", kind)), batch)


def maintain_graph(
    events: DataFrame, store: EdgeStore, load_files: Callable[[DataFrame], DataFrame], checkpoint: str,
    max_depth: int = DEFAULT_DEPTH, mounts: DataFrame | None = None, **trigger,
):
    """Start a streaming query that keeps the store current."""
    path = store.spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    if not path.getFileSystem(store.spark._jsc.hadoopConfiguration()).exists(path):
        store.begin()
    update = lambda rows, batch: apply_batch(store, rows, batch, load_files, max_depth, mounts)
    return (
        events.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )
