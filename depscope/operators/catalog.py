"""Reports and checks over mount, repository and backend tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from depscope.operators.resolve import BACKEND_NAMES, case_of, first_mount, resolve_paths

# Kinds a declared backend may have.
BACKEND_TYPES = ("s3", "git", "local")


def is_fresh(exists: Column, modified_at: Column, ttl: Column, now: Column) -> Column:
    """Whether a cached file may be used: it exists and is younger than its time to live (0 = for ever)."""
    age = F.greatest(now - modified_at, F.lit(0))
    return exists & ((ttl == 0) | F.coalesce(age < ttl, F.lit(False)))


def needs_pull(fetched_at: Column, interval: Column, now: Column, inclusive: bool = False) -> Column:
    """Whether a clone is due: never fetched, or fetched longer ago than the interval."""
    age = F.greatest(now - fetched_at, F.lit(0))
    return fetched_at.isNull() | (age >= interval if inclusive else age > interval)


def staleness_report(catalog: DataFrame, now: int, inclusive: bool = False) -> DataFrame:
    """Add `fresh` and `needs_pull`. Times are epoch seconds: cached_at, ttl, fetched_at, pull_interval."""
    at = F.lit(now).cast("bigint")
    return catalog.select(
        "*",
        is_fresh(F.col("cached_at").isNotNull(), F.col("cached_at"), F.col("ttl"), at).alias("fresh"),
        needs_pull(F.col("fetched_at"), F.col("pull_interval"), at, inclusive).alias("needs_pull"),
    )


def backend_summary(mounts: DataFrame) -> DataFrame:
    """One row per configured backend."""
    location = (
        F.when(F.col("kind") == "s3", F.concat(F.lit("s3://"), F.coalesce("bucket", F.lit("?")), F.lit("/"), F.coalesce("prefix", F.lit(""))))
        .when(F.col("kind") == "remote", F.coalesce("url", F.lit("?"))).otherwise(F.coalesce("path", F.lit("?")))
    )
    return mounts.select(
        case_of(F.col("kind"), BACKEND_NAMES).alias("backend"), location.alias("location"), "at",
        F.when(F.col("kind") == "s3", F.coalesce("writable", F.lit(False))).alias("writable"),
        F.lit("configured").alias("status"),
    )


def mount_plan(mounts: DataFrame, repos: DataFrame, backends: DataFrame, worktree_root: str) -> DataFrame:
    """Backing path of each mount: its repository if one has the source name, else its backend.

    Tables carry `workspace` and `ord`; a mount whose source is unknown is dropped.
    """
    repo = repos.groupBy("workspace", "name").agg(F.min(F.struct("ord", "writable")).alias("repo"))
    backend = backends.groupBy("workspace", "name").agg(F.min(F.struct("ord", "mount_point")).alias("backend"))
    named = mounts.withColumnRenamed("source", "name")
    joined = named.join(repo, ["workspace", "name"], "left").join(backend, ["workspace", "name"], "left")
    root = worktree_root.rstrip("/")
    return joined.where(F.col("repo").isNotNull() | F.col("backend").isNotNull()).select(
        "workspace", "name",
        F.when(F.col("repo").isNotNull(), F.concat(F.lit(root + "/"), F.col("name")))
        .otherwise(F.col("backend.mount_point")).alias("backing_path"),
        "at", F.when(F.col("repo").isNotNull(), F.col("repo.writable")).otherwise(F.lit(False)).alias("writable"), "ord",
    )


def _finding(condition: Column, field: Column, message) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.struct(field.alias("field"), message.alias("message")))


def _findings(table: DataFrame, *checks: Column) -> DataFrame:
    return table.select("workspace", F.explode(F.array_compact(F.array(*checks))).alias("f")).groupBy(
        "workspace", "f.field", "f.message"
    ).agg(F.count("*").alias("occurrences"))


def _duplicates(table: DataFrame, key: str, field, message: str) -> DataFrame:
    """Values that occur again; occurrences after the first are counted."""
    repeated = table.groupBy("workspace", key).agg((F.count("*") - 1).alias("occurrences")).where("occurrences > 0")
    return repeated.select("workspace", field(F.col(key)).alias("field"), F.lit(message).alias("message"), "occurrences")


def _named(prefix: str, suffix: str = ""):
    return lambda name: F.concat(F.lit(prefix), name, F.lit(suffix))


def validate_catalog(repos: DataFrame, backends: DataFrame, mounts: DataFrame) -> DataFrame:
    """Every fault in the declarations of many workspaces, as (workspace, field, message, occurrences)."""
    c = F.col
    sources = repos.select("workspace", "name").unionByName(backends.select("workspace", "name")).distinct()
    dangling = (
        mounts.where(c("source") != "").join(sources.withColumnRenamed("name", "source"), ["workspace", "source"], "left_anti")
        .select(
            "workspace", _named("mounts.", ".source")(c("source")).alias("field"),
            F.concat(F.lit("mount source '"), c("source"), F.lit("' does not reference a declared repo or backend")).alias("message"),
        ).groupBy("workspace", "field", "message").agg(F.count("*").alias("occurrences"))
    )
    bad_type = F.concat(F.lit("invalid backend type '"), c("type"), F.lit("', must be s3/git/local"))
    parts = [
        _findings(
            repos,
            _finding(c("name") == "", F.lit("repos[].name"), "repo name must not be empty"),
            _finding(c("url") == "", _named("repos.", ".url")(c("name")), "repo url must not be empty"),
            _finding(c("ref") == "", _named("repos.", ".ref")(c("name")), "repo ref must not be empty"),
        ),
        _duplicates(repos, "name", _named("repos."), "duplicate repo name"),
        _findings(
            backends,
            _finding(c("name") == "", F.lit("backends[].name"), "backend name must not be empty"),
            _finding(~c("type").isin(*BACKEND_TYPES), _named("backends.", ".type")(c("name")), bad_type),
            _finding(c("mount_point") == "", _named("backends.", ".mount_point")(c("name")), "backend mount_point must not be empty"),
        ),
        _duplicates(backends, "name", _named("backends."), "duplicate backend name"),
        _findings(
            mounts,
            _finding(c("source") == "", F.lit("mounts[].source"), "mount source must not be empty"),
            _finding(c("at") == "", F.lit("mounts[].at"), "mount path must not be empty"),
        ),
        dangling,
        _duplicates(mounts, "at", _named("mounts.at="), "duplicate mount point"),
    ]
    return reduce(DataFrame.unionByName, parts)


def backend_status(paths: DataFrame, mounts: DataFrame, inventory: DataFrame, blobs: DataFrame, workspace: str, now: int) -> DataFrame:
    """Resolved place of each path, whether its cached copy is fresh, and its latest upload.

    `inventory` has `path` and `mtime` (epoch seconds); `ttl` comes from the mount.
    """
    placed = resolve_paths(paths, mounts, inventory, workspace)
    ttl = first_mount(paths, mounts).select("path", F.coalesce(F.col("mount.ttl"), F.lit(0)).alias("ttl"))
    stamped = inventory.groupBy(F.col("path").alias("real_path")).agg(F.max("mtime").alias("mtime"))
    last = blobs.groupBy("path").agg(F.max(F.struct("uploaded_at", "hash")).alias("last"))
    return (
        placed.join(ttl, "path").join(stamped, "real_path", "left").join(last, "path", "left")
        .select(
            "path", "backend", "real_path",
            is_fresh(F.col("cached"), F.col("mtime"), F.col("ttl"), F.lit(now)).alias("cache_hit"),
            F.col("last.uploaded_at").alias("last_synced"), F.col("last.hash").alias("hash"),
        )
    )
