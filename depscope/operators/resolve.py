"""Where virtual paths live: mounts, backing folders and listings.

A mount applies to a path if its `at` is a string prefix of the path. The prefix
test is an equi join: the lengths that mount points have are few, and a path has
one prefix of each. Which side is small enough to broadcast is left to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depscope.functions.paths import join_path

# Mounts are looked at kind by kind in this order.
KIND_ORDER = {"s3": 0, "remote": 1, "local": 2}
BACKEND_NAMES = {"s3": "s3", "remote": "git", "local": "local"}


def case_of(column: Column, values: dict) -> Column:
    result = None
    for key, value in values.items():
        result = F.when(column == key, value) if result is None else result.when(column == key, value)
    return result


def _prefix_candidates(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    lengths = mounts.select(F.collect_set(F.length("at"))).scalar()
    return (
        paths.select("path").distinct().select("path", F.explode(lengths).alias("_length"))
        .where(F.col("_length") <= F.length("path"))
        .select("path", F.substring(F.col("path"), F.lit(1), F.col("_length")).alias("_at"))
    )


def first_mount(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Each path once, with the first mount that applies to it as `mount`, else null."""
    ranked = mounts.select(
        F.col("at").alias("_at"),
        F.struct(
            case_of(F.col("kind"), KIND_ORDER).alias("kind_ord"), "ord", "kind", "at", "bucket", "prefix", "url",
            F.col("path").alias("target"), "cache", "ttl", "writable",
        ).alias("mount"),
    )
    # The first mount of each mount point is enough, so the join does not multiply rows.
    first_at = ranked.groupBy("_at").agg(F.min("mount").alias("mount"))
    matched = _prefix_candidates(paths, mounts).join(first_at, "_at").groupBy("path").agg(F.min("mount").alias("mount"))
    return paths.select("path").distinct().join(matched, "path", "left")


def resolve_paths(paths: DataFrame, mounts: DataFrame, inventory: DataFrame, workspace: str) -> DataFrame:
    """(path, real_path, backend, cached, sync_status) of each distinct path.

    `inventory` lists the files and folders that exist, in a `path` column.
    """
    mount = F.col("mount")
    below = F.substring(F.col("path"), F.length(mount["at"]) + 1, F.length("path"))
    in_bucket = F.concat(F.lit("s3://"), mount["bucket"], F.lit("/"), F.coalesce(mount["prefix"], F.lit("")))
    worktree = F.concat(
        F.coalesce(mount["cache"], F.lit("/tmp")), F.lit("/"), F.replace(mount["url"], F.lit("/"), F.lit("_"))
    )
    real = (
        F.when(mount.isNull(), join_path(F.lit(workspace), F.col("path")))
        .when((mount["kind"] == "s3") & mount["cache"].isNotNull(), join_path(mount["cache"], below))
        .when(mount["kind"] == "s3", in_bucket)
        .when(mount["kind"] == "remote", worktree)
        .otherwise(mount["target"])
    )
    placed = first_mount(paths, mounts).select(
        "path", real.alias("real_path"),
        F.when(mount.isNull(), "local").otherwise(case_of(mount["kind"], BACKEND_NAMES)).alias("backend"),
        (mount["kind"] == "s3").alias("_s3"), mount["cache"].isNull().alias("_uncached"), mount.isNull().alias("_free"),
    )
    present = inventory.select(F.col("path").alias("real_path")).distinct().withColumn("_exists", F.lit(True))
    exists = F.coalesce("_exists", F.lit(False))
    status = (
        F.when(F.col("_free"), F.when(exists, "synced").otherwise("not found on disk"))
        .when(F.col("backend") == "local", "synced").otherwise("unknown")
    )
    return placed.join(present, "real_path", "left").select(
        "path", "real_path", "backend",
        (exists & ~F.coalesce(F.col("_s3") & F.col("_uncached"), F.lit(False))).alias("cached"),
        status.alias("sync_status"),
    )


def list_mounts(mounts: DataFrame, directory: str) -> DataFrame:
    """The mounts at or below a folder as virtual entries, in mount order."""
    kept = mounts if directory == "/" else mounts.where(F.col("at").startswith(directory))
    return kept.orderBy(case_of(F.col("kind"), KIND_ORDER), "ord").select(
        F.ltrim("at", F.lit("/")).alias("name"), F.lit("directory").alias("entry_type"),
        case_of(F.col("kind"), BACKEND_NAMES).alias("backend"), F.lit(None).cast("bigint").alias("size"),
        F.lit(True).alias("virtual"),
    )


def list_children(files: DataFrame, directory: str = "") -> DataFrame:
    """Direct children of a folder: files with their size, folders implied by paths below."""
    prefix = directory.strip("/") + "/" if directory.strip("/") else ""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    below = files.where(F.col("path").startswith(prefix)).select(
        F.element_at(F.split(rest, "/"), 1).alias("name"), rest.contains("/").alias("_dir"), "length"
    )
    return below.groupBy("name").agg(
        F.when(F.max("_dir"), "directory").otherwise("file").alias("entry_type"),
        F.when(~F.max("_dir"), F.sum("length")).alias("size"),
    ).orderBy("name")


def to_backend_path(paths: DataFrame, at: str, root: str, inventory: DataFrame) -> DataFrame:
    """Paths of one backend in its own storage, with a flag that says whether they exist."""
    below = F.when(
        F.col("path").startswith(at), F.substring(F.col("path"), len(at) + 1, 1 << 30)
    ).otherwise(F.col("path"))
    present = inventory.select(F.col("path").alias("real_path")).distinct().withColumn("_exists", F.lit(True))
    return (
        paths.select("path", join_path(F.lit(root), below).alias("real_path")).join(present, "real_path", "left")
        .select("path", "real_path", F.coalesce("_exists", F.lit(False)).alias("found"))
    )


def route_workspace(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """Backing path of workspace paths by their first component; null outside every mount.

    `plan` is a mount plan: (workspace, name, backing_path, at, writable, ord); paths are (workspace, path). A plan without
    the column is one workspace's, and then so are the paths. Each path meets mounts of its own workspace only.
    """
    last = F.element_at(F.split(F.regexp_replace("at", "/+$", ""), "/"), -1)
    own = ["workspace"] if "workspace" in plan.columns else []
    if own and "workspace" not in paths.columns:
        raise ValueError("the plan has several workspaces, so paths need the column workspace")
    owners = (
        plan.select(*own, last.alias("_segment"), F.struct("ord", "name", "backing_path", "writable").alias("owner"))
        .groupBy(*own, "_segment").agg(F.min("owner").alias("owner"))
    )
    clean = F.regexp_replace("path", "^/", "")
    routed = paths.withColumn("_segment", F.element_at(F.split(clean, "/"), 1)).join(owners, [*own, "_segment"], "left")
    rest = F.when(clean.contains("/"), F.regexp_replace(clean, "(?s)^[^/]*/", ""))
    backing = F.col("owner.backing_path")
    real = F.when(rest.isNull(), backing).when(
        backing.endswith("/"), F.concat(backing, rest)
    ).otherwise(F.concat(backing, F.lit("/"), rest))
    return routed.select(*own, "path", F.col("owner.name").alias("mount"), real.alias("real_path"), F.col("owner.writable").alias("writable"))
