"""Access rules: ordered globs that give a path its mode."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depscope import scratch
from depscope.functions.globs import anchors, glob_to_regex, matches_any
from depscope.functions.paths import strip_leading_dot_slash

DEFAULT_FILE_MODE = 0o644
READ_BITS, WRITE_BIT, EXECUTE_BITS, READ_ONLY_MASK = 0o444, 0o200, 0o111, 0o555


@dataclass(frozen=True)
class AccessRule:
    paths: tuple[str, ...]
    mode: int
    allow_delete: bool = False


# The protections a tree has unless told otherwise.
DEFAULT_PROTECTIONS = (
    AccessRule((".vfs/**",), 0o444),
    AccessRule((".git/**",), 0o444),
    AccessRule((".gitignore",), 0o444),
    AccessRule(("**/*.sum",), 0o444),
    AccessRule(("**/*.lock",), 0o444),
    AccessRule(("**/*.pb.go",), 0o444),
    AccessRule(("**/*.gen.go",), 0o444),
    AccessRule(("**/vendor/**",), 0o444),
    AccessRule(("**/node_modules/**",), 0o444),
    AccessRule((".github/workflows/**",), 0o444),
    AccessRule(("src/**",), 0o644, True),
    AccessRule(("lib/**",), 0o644, True),
    AccessRule(("cmd/**",), 0o644, True),
)


def rules_table(spark: SparkSession, rules: Sequence[AccessRule] = DEFAULT_PROTECTIONS) -> DataFrame:
    """The rules as rows, in order."""
    rows = [(i, list(r.paths), r.mode, r.allow_delete) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, paths array<string>, mode int, allow_delete boolean")


def _first_match(path: Column, rules: Sequence[AccessRule], value) -> Column | None:
    clean, result = strip_leading_dot_slash(path), None
    for rule in rules:
        hit = matches_any(clean, rule.paths)
        result = F.when(hit, value(rule)) if result is None else result.when(hit, value(rule))
    return result


def mode_of(path: Column, rules: Sequence[AccessRule], default: int = DEFAULT_FILE_MODE) -> Column:
    """Mode of the first rule with a glob that matches; one expression, no join."""
    matched = _first_match(path, rules, lambda r: F.lit(r.mode))
    return F.lit(default) if matched is None else matched.otherwise(F.lit(default))


def deletable(path: Column, rules: Sequence[AccessRule]) -> Column:
    """The delete flag of the first rule that matches, null where none does."""
    matched = _first_match(path, rules, lambda r: F.lit(r.allow_delete))
    return F.lit(None).cast("boolean") if matched is None else matched


def readable(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(READ_BITS)) != 0


def writable(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(WRITE_BIT)) != 0


def executable(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(EXECUTE_BITS)) != 0


OPERATIONS = {
    "read": readable,
    "write": writable,
    "execute": executable,
    # Opening for update needs both bits.
    "rw": lambda mode: readable(mode) & writable(mode),
}


def _with_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame = frame.assign(regex=frame["glob"].map(glob_to_regex))
        frame = frame[frame["regex"].notna()]
        yield frame.assign(anchors=frame["glob"].map(anchors).astype(object))[["glob", "anchors", "regex", "ord", "mode", "allow_delete"]]


def index_rules(rules: DataFrame) -> DataFrame:
    """Rules of a table (ord, paths, mode, allow_delete) by a text their globs require: (anchor, regex, rule), stored.

    Of the texts that a glob requires, the one that the fewest globs require counts, so that globs which share a
    folder or an ending are not all candidates of every path there. Null and invalid globs match nothing and are
    left out. Of equal globs the first rule counts.
    """
    globs = rules.select(F.explode("paths").alias("glob"), "ord", "mode", "allow_delete").where("glob IS NOT NULL")
    # The smallest rule per glob, before any Python.
    first = globs.groupBy("glob").agg(F.min(F.struct("ord", "mode", "allow_delete")).alias("r")).select("glob", "r.*")
    made = first.mapInPandas(_with_anchors, "glob string, anchors array<string>, regex string, ord long, mode int, allow_delete boolean")
    made = scratch.materialize(made.select("glob", F.explode("anchors").alias("anchor"), "regex", F.struct("ord", "mode", "allow_delete").alias("rule")), "globs")
    crowd = made.groupBy("anchor").agg(F.count("*").alias("_globs"))
    best = F.min_by(F.struct("anchor", "regex", "rule"), F.struct("_globs", -F.length("anchor"), "anchor")).alias("best")
    index = scratch.materialize(made.join(crowd, "anchor").groupBy("glob").agg(best).select("best.*"), "rules")
    scratch.drop(made)
    return index


def _lengths(index: DataFrame, mark: str) -> Column:
    """The lengths of one kind of anchor: no more than the longest glob has characters."""
    of_kind = index.where(F.col("anchor").startswith(mark))
    return of_kind.agg(F.array_sort(F.collect_set(F.length("anchor") - 1)).alias("n")).scalar()


def first_rules(paths: DataFrame, index: DataFrame) -> DataFrame:
    """(path, rule) for each distinct path that some rule of `index_rules` matches; the smallest `ord` wins.

    Paths meet rules by an equi join on anchors: a path looks up itself, its beginnings and ends of the lengths that
    occur, and its substrings of the few lengths of inner anchors. Only those candidates are tested by their regex.
    """
    clean = F.col("clean")
    fitting = lambda mark: F.filter(F.col(f"n{ord(mark)}"), lambda n: n <= F.length(clean))
    inner = F.flatten(F.transform(fitting("~"), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(clean) - n + 1), lambda i: F.concat(F.lit("~"), F.substring(clean, i, n))
    )))
    anchors = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("="), clean), F.lit("*")),
        F.transform(fitting("^"), lambda n: F.concat(F.lit("^"), F.substring(clean, F.lit(1), n))),
        F.transform(fitting("$"), lambda n: F.concat(F.lit("$"), F.substring(clean, F.length(clean) - n + 1, n))),
        inner,
    ))
    asked = paths.select("path").where("path IS NOT NULL").distinct().select("path", strip_leading_dot_slash(F.col("path")).alias("clean"))
    asked = asked.select("*", *[_lengths(index, mark).alias(f"n{ord(mark)}") for mark in "^$~"])
    candidates = asked.select("path", "clean", F.explode(anchors).alias("anchor")).join(index, "anchor")
    return candidates.where(F.rlike("clean", F.col("regex"))).groupBy("path").agg(F.min("rule").alias("rule"))


def compute_mode_by_table(paths: DataFrame, rules: DataFrame, default: int = DEFAULT_FILE_MODE) -> DataFrame:
    """`compute_mode` for rules given as a table, of any number; also `allow_delete`, null where no rule matches.

    A null path gets the default mode. Rules of equal `ord` are taken by smaller mode. Columns `mode` and
    `allow_delete` of the paths are replaced.
    """
    found = first_rules(paths, index_rules(rules)).select(F.col("path").alias("_path"), F.col("rule").alias("_rule"))
    return (
        paths.drop("mode", "allow_delete").join(found, F.col("path") == F.col("_path"), "left")
        .withColumn("mode", F.coalesce("_rule.mode", F.lit(default))).withColumn("allow_delete", F.col("_rule.allow_delete"))
        .drop("_path", "_rule")
    )


def compute_mode(paths: DataFrame, rules: Sequence[AccessRule], default: int = DEFAULT_FILE_MODE) -> DataFrame:
    return paths.withColumn("mode", mode_of(F.col("path"), rules, default))


def apply_rule(paths: DataFrame, rule: AccessRule) -> DataFrame:
    """Struct (mode, readable, writable) where the rule matches, else null."""
    mode = F.lit(rule.mode)
    result = F.struct(mode.alias("mode"), readable(mode).alias("readable"), writable(mode).alias("writable"))
    hit = matches_any(strip_leading_dot_slash(F.col("path")), rule.paths)
    return paths.withColumn("permission", F.when(hit, result))


def check_access(
    paths: DataFrame, rules: Sequence[AccessRule], operation: str, default: int = DEFAULT_FILE_MODE
) -> DataFrame:
    """Whether an operation is allowed on each path; a denied row says on what grounds."""
    allowed = OPERATIONS[operation](F.col("mode"))
    denied = F.struct(
        strip_leading_dot_slash(F.col("path")).alias("path"), F.lit(operation).alias("operation"), F.col("mode").alias("mode")
    )
    return (
        compute_mode(paths, rules, default)
        .withColumn("allowed", allowed).withColumn("denied", F.when(~F.col("allowed"), denied))
    )


def mask_read_only(files: DataFrame) -> DataFrame:
    """Drop the write bits of files on a mount that is not writable."""
    masked = F.when(F.col("writable"), F.col("mode")).otherwise(F.col("mode").bitwiseAND(F.lit(READ_ONLY_MASK)))
    return files.withColumn("mode", masked)
