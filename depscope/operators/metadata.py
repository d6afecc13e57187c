"""Per-file key/value metadata as a table (path, key, value, version).

The highest version of a (path, key) pair is its value. Latest values are found
by a partial aggregate, so a pair with very many versions is reduced before it
is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depscope.schemas import METADATA

# Fixed value: every key carries this prefix once.
KEY_PREFIX = "user.vfs."


def full_key(key: Column) -> Column:
    """The key with the prefix, whether or not it was given."""
    return F.concat(F.lit(KEY_PREFIX), short_key(key))


def short_key(key: Column) -> Column:
    return F.regexp_replace(key, r"^user\.vfs\.", "")


def unescape_newlines(value: Column) -> Column:
    """Typed-in `\\n` as a line break."""
    return F.replace(value, F.lit("\\n"), F.lit("\n"))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def hash_metadata(files: DataFrame, version) -> DataFrame:
    return files.select(
        "path", F.lit(KEY_PREFIX + "hash").alias("key"), content_hash(F.col("content")).alias("value"),
        F.lit(version).cast("bigint").alias("version"),
    )


def _normalized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", full_key(F.col("key")))


def latest(meta: DataFrame) -> DataFrame:
    """One row per (path, key): the one with the highest version; of equal ones the largest value."""
    return _newest(meta.withColumn("_given", F.lit(0)))


def _newest(rows: DataFrame) -> DataFrame:
    """The highest (version, given) of each pair: at equal versions what is given later wins, whatever its value."""
    best = F.max(F.struct("version", "_given", "value")).alias("best")
    return (
        rows.groupBy("path", "key").agg(best)
        .select("path", "key", F.col("best.value").alias("value"), F.col("best.version").alias("version"))
    )


def set_metadata(meta: DataFrame, updates: DataFrame) -> DataFrame:
    """The table after a batch of updates; an update wins over what is there at the same version."""
    there = meta.select(*METADATA.names).withColumn("_given", F.lit(0))
    return _newest(there.unionByName(_normalized(updates).select(*METADATA.names).withColumn("_given", F.lit(1))))


def previous_values(meta: DataFrame, updates: DataFrame) -> DataFrame:
    """Each updated pair with its new value and the one it replaces, null if none."""
    new = latest(_normalized(updates))
    old = latest(meta).select("path", "key", F.col("value").alias("previous_value"))
    return new.join(old, ["path", "key"], "left").select("path", "key", "value", "previous_value")


def get_metadata(meta: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """A row per path and asked-for key; the value of a missing one is null."""
    full = [KEY_PREFIX + k.removeprefix(KEY_PREFIX) for k in keys]
    asked = paths.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, full))).alias("key"))
    kept = meta.where(F.col("key").isin(*full))
    return asked.join(latest(kept).select("path", "key", "value"), ["path", "key"], "left")


def list_metadata(meta: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(path, key) of the prefixed keys, for all files or for some."""
    kept = meta.where(F.col("key").startswith(KEY_PREFIX)).select("path", "key").distinct()
    return kept if paths is None else kept.join(paths.select("path").distinct(), "path", "left_semi")


def remove_metadata(meta: DataFrame, removals: DataFrame) -> DataFrame:
    """The table without the given (path, key) pairs."""
    gone = _normalized(removals).select("path", "key").distinct()
    return meta.join(gone, ["path", "key"], "left_anti")


def metadata_map(meta: DataFrame) -> DataFrame:
    """All keys of a file as one map. A map holds each key of a file once."""
    kept = latest(meta.where(F.col("key").startswith(KEY_PREFIX)))
    return kept.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def metadata_columns(meta: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file with a column for each named key."""
    full = {k: KEY_PREFIX + k.removeprefix(KEY_PREFIX) for k in keys}
    kept = latest(meta.where(F.col("key").isin(*full.values())))
    return kept.groupBy("path").agg(
        *[F.max(F.when(F.col("key") == name, F.col("value"))).alias(short) for short, name in full.items()]
    )
