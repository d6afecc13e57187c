"""Scalar column functions on paths, edge targets and settings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXTERNAL = "external:"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_prefix(path: Column) -> Column:
    """The folder of a path with its trailing slash; empty at the top."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(file_name(path)))


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; empty without one or for a dot file."""
    tail = F.substring_index(path, ".", -1)
    # No dot at all, or only one that begins the file name.
    none = tail.contains("/") | (F.length(path) <= F.length(tail) + 1) | path.endswith(F.concat(F.lit("/."), tail))
    return F.when(none, "").otherwise(tail)


def first_segment(path: Column) -> Column:
    return F.element_at(F.split(F.ltrim(path, F.lit("/")), "/"), 1)


def format_external(repo: Column, path: Column) -> Column:
    return F.concat(F.lit(EXTERNAL), repo, F.lit(":"), path)


def is_external(target: Column) -> Column:
    return target.startswith(EXTERNAL)


def parse_external(target: Column) -> Column:
    """(repo, path) of an external target, null for any other."""
    pattern = r"(?s)^external:([^:]*):(.*)$"
    return F.when(
        target.rlike(pattern),
        F.struct(
            F.regexp_extract(target, pattern, 1).alias("repo"),
            F.regexp_extract(target, pattern, 2).alias("path"),
        ),
    )


def octal_mode(text: Column) -> Column:
    """Permission bits from octal text such as 644, 0644 or 0o644; null if not octal."""
    digits = F.regexp_replace(F.trim(text), "^0[oO]", "")
    return F.when(digits.rlike("^[0-7]+$"), F.conv(digits, 8, 10).cast("int"))


def duration_ms(text: Column) -> Column:
    """Milliseconds of `500ms`, `2s` or a bare number; anything else is 0."""
    number = F.regexp_extract(text, r"^\+?([0-9]+)(?:ms|s)?$", 1).try_cast("bigint")
    seconds = text.endswith("s") & ~text.endswith("ms")
    return F.coalesce(F.when(seconds, number * 1000).otherwise(number), F.lit(0).cast("bigint"))


def repo_folder_name(url: Column) -> Column:
    """A folder name for a repository address."""
    bare = F.regexp_replace(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), "git@", "")
    return F.translate(bare, ":/.", "___")


def join_path(base: Column, rest: Column) -> Column:
    """Base and relative part joined by one slash; an absolute or empty part follows path rules."""
    rest = F.ltrim(rest, F.lit("/"))
    return F.when(base == "", rest).when(base.endswith("/"), F.concat(base, rest)).otherwise(F.concat(base, F.lit("/"), rest))


def cache_path(cache: Column, bucket: Column, key: Column) -> Column:
    return join_path(join_path(cache, bucket), key)


def render_template(template: Column, path: Column) -> Column:
    return F.replace(template, F.lit("{{ .FilePath }}"), path)


def strip_leading_dot_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"^(?:\./)+", "")
