"""Import targets as the files they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depscope.functions.paths import file_name, parent_prefix
from depscope.schemas import EDGE_COLUMNS

# What a local target may leave out at its end.
LOCAL_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".rb", "/index.ts", "/index.js")
MODULE_ENDINGS = (".py", "/__init__.py")
_ENDINGS = LOCAL_ENDINGS + MODULE_ENDINGS
# A part that `normalized` takes away, anywhere in a path and at its end.
_FOLDED = r"(?:^|/)\.{0,2}(?:/|\z)"


def normalized(path: Column) -> Column:
    """The path without `.` parts, and with each `..` taken back; one too many stays."""
    up = lambda done: (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
    step = lambda done, part: (
        F.when(part.isin("", "."), done)
        .when((part == "..") & up(done), F.slice(done, F.lit(1), F.size(done) - 1))
        .otherwise(F.concat(done, F.array(part)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    folded = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    may_fold = path.contains("./") | path.contains("//") | path.startswith("/") | path.endswith("/") | path.endswith(".") | (path == "")
    return F.when(may_fold & path.rlike(_FOLDED), folded).otherwise(path)


def _bases(source: Column, target: Column) -> tuple[Column, Column, Column]:
    """What the paths of a local target begin with, and those of a module: beside the file that names it, and from the top."""
    folder, name = parent_prefix(source), F.substring(target, F.instr(target, ":") + 1, F.length(target))
    module = F.replace(name, F.lit("."), F.lit("/"))
    return F.concat(folder, name), F.concat(folder, module), module


def _chosen(source: Column, target: Column, local: Column, python: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(target.startswith("local:"), local).when(target.startswith("pkg:") & source.endswith(".py"), python).otherwise(none)


def candidates(source: Column, target: Column) -> Column:
    """The paths a prefixed target may mean, seen from the file that names it."""
    base, beside, top = _bases(source, target)
    local = F.array(*[F.concat(base, F.lit(end)) for end in LOCAL_ENDINGS])
    python = F.array(*[F.concat(module, F.lit(end)) for module in (beside, top) for end in MODULE_ENDINGS])
    return F.array_distinct(F.transform(_chosen(source, target, local, python), normalized))


def _keys(source: Column, target: Column) -> Column:
    """One or two keys that every candidate of a target shares with the file it is: what stands before the ending.

    A base whose last part would be taken away has its candidates as keys.
    """
    base, beside, top = _bases(source, target)
    ended = F.array(*[F.lit(end) for end in _ENDINGS])
    keys = lambda b: F.when(file_name(b).isin("", ".", ".."), F.transform(ended, lambda end: normalized(F.concat(b, end)))).otherwise(F.array(normalized(b)))
    return F.array_distinct(F.flatten(F.transform(_chosen(source, target, F.array(base), F.array(beside, top)), keys)))


def _stems(path: Column) -> Column:
    """(_key, _end): a path without each ending it has, also the empty one."""
    cut = lambda end: F.struct(F.substring(path, F.lit(1), F.length(path) - len(end)).alias("_key"), F.lit(end).alias("_end"))
    return F.array_compact(F.array(*[F.when(path.endswith(end), cut(end)) for end in _ENDINGS]))


def may_mean_file(edges: DataFrame) -> DataFrame:
    """The edges whose target can mean a file."""
    return edges.where(F.col("to").startswith("local:") | (F.col("to").startswith("pkg:") & F.col("from").endswith(".py")))


def resolved_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose target is one of the files (path), with that path as target. Other edges are left out, other columns kept.

    Targets meet files by what both have before an ending, so that an edge is one or two rows and not one per
    candidate; the candidates are then tested on the few that met.
    """
    named = may_mean_file(edges).withColumn("_key", F.explode(_keys(F.col("from"), F.col("to"))))
    stems = files.select(F.inline(_stems(F.col("path"))))
    met = named.join(stems, "_key").withColumn("_path", F.concat("_key", "_end"))
    met = met.where(F.array_contains(candidates(F.col("from"), F.col("to")), F.col("_path")))
    return met.withColumn("to", F.col("_path")).select(*edges.columns).distinct()
