"""Edges implied by names: tests and their sources, other repositories, glob pairs."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from depscope.functions.globs import matches_glob
from depscope.functions.paths import file_name, format_external, parent_prefix
from depscope.schemas import EDGE_COLUMNS

# Names of test files, as pattern and replacement. A name is tried
# against them in this order, and a `test_` name with another extension has no source.
TEST_ENDING = (r"_test\.(go|rs|cpp|rb)$", ".$1")
TEST_PREFIX, TEST_PREFIXED = "test_", r"^test_(.*\.(?:py|c))$"
TEST_OR_SPEC = (r"\.(?:test|spec)\.ts$", ".ts")
TEST_CLASS = (r"Test\.java$", ".java")
# Test names of a source file by extension, as (prefix, suffix).
TESTS_OF_SOURCE = {
    ".go": (("", "_test.go"),), ".py": (("test_", ".py"),), ".ts": (("", ".test.ts"), ("", ".spec.ts")),
    ".rs": (("", "_test.rs"),), ".java": (("", "Test.java"),), ".c": (("test_", ".c"),),
    ".cpp": (("", "_test.cpp"),), ".rb": (("", "_test.rb"),),
}


def _swap_suffix(name: Column, old: str, new: str) -> Column:
    return F.concat(F.substring(name, F.lit(1), F.length(name) - len(old)), F.lit(new))


def source_of_test(name: Column) -> Column:
    """The source file name a test file name stands for, else null."""
    prefixed = F.nullif(F.regexp_extract(name, TEST_PREFIXED, 1), F.lit(""))
    # Most names have none of the literal parts, and are told by them.
    return (
        F.when(name.contains("_test.") & name.rlike(TEST_ENDING[0]), F.regexp_replace(name, *TEST_ENDING))
        .when(name.startswith(TEST_PREFIX), prefixed)
        .when((name.contains(".test.") | name.contains(".spec.")) & name.rlike(TEST_OR_SPEC[0]), F.regexp_replace(name, *TEST_OR_SPEC))
        .when(name.contains("Test.java") & name.rlike(TEST_CLASS[0]), F.regexp_replace(name, *TEST_CLASS))
    )


def tests_of_source(name: Column) -> Column:
    """The test file names a source file name may have."""
    result = None
    for ext, forms in TESTS_OF_SOURCE.items():
        names = F.array(*[F.concat(F.lit(pre), _swap_suffix(name, ext, suf)) for pre, suf in forms])
        result = F.when(name.endswith(ext), names) if result is None else result.when(name.endswith(ext), names)
    return result


def _named_sources(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("from"),
        F.concat(parent_prefix(F.col("path")), source_of_test(file_name(F.col("path")))).alias("to"),
        F.lit("tested_by").alias("rel"),
    ).where(F.col("to").isNotNull())


def _named_tests(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("path").alias("from"), F.explode(tests_of_source(file_name(F.col("path")))).alias("_test")
    ).select(
        "from", F.concat(parent_prefix(F.col("from")), F.col("_test")).alias("to"), F.lit("tests").alias("rel")
    )


def _existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    return candidates.join(files.select(F.col("path").alias("to")), "to", "left_semi").select(*EDGE_COLUMNS)


def tested_by(files: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Edges from each test file to its source in the same folder, where that exists among the files or the given ones."""
    return _existing(_named_sources(files), among or files)


def tests(files: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Edges from each source file to its tests in the same folder, where they exist among the files or the given ones."""
    return _existing(_named_tests(files), among or files)


def test_associations(files: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Both, by one join with the files."""
    return _existing(_named_sources(files).unionByName(_named_tests(files)), among or files)


def partners(paths: DataFrame) -> DataFrame:
    """(path) of every file name whose test edges depend on whether one of these files exists; some come twice."""
    parts = paths.select(parent_prefix(F.col("path")).alias("_folder"), file_name(F.col("path")).alias("_file"))
    named = F.concat(F.array(source_of_test(F.col("_file"))), F.coalesce(tests_of_source(F.col("_file")), F.array().cast("array<string>")))
    return parts.select("_folder", F.explode(named).alias("_name")).where("_name IS NOT NULL").select(F.concat("_folder", "_name").alias("path"))


def repo_prefixes(mounts: DataFrame) -> DataFrame:
    """(repo, segment): the last component of each mount; the smallest repo owns a shared one."""
    segment = F.element_at(F.split(F.regexp_replace("at", "/+$", ""), "/"), -1)
    return mounts.select(F.col("source").alias("repo"), segment.alias("segment")).groupBy("segment").agg(F.min("repo").alias("repo"))


def flag_external(edges: DataFrame, mounts: DataFrame) -> DataFrame:
    """Rewrite targets that lie in another mounted repository to `external:repo:path`."""
    owners = repo_prefixes(mounts)
    segment = F.when(F.col("to").contains("/"), F.element_at(F.split("to", "/"), 1))
    rest = F.regexp_replace(F.regexp_replace(F.expr("substring(`to`, instr(`to`, '/') + 1)"), "^/+", ""), r"^\\+", "")
    joined = edges.withColumn("_segment", segment).join(owners, F.col("_segment") == F.col("segment"), "left")
    target = F.when(F.col("repo").isNotNull(), format_external(F.col("repo"), rest)).otherwise(F.col("to"))
    return joined.select("from", target.alias("to"), "rel")


def _placed(files: DataFrame, pattern: str, name: str) -> DataFrame:
    fixed = itertools.takewhile(lambda part: not set(part) & set("*?["), pattern.split("/")[:-1])
    base = "".join(part + "/" for part in fixed)
    below = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    return files.where(matches_glob(F.col("path"), pattern)).select(
        F.col("path").alias(name), F.regexp_replace(below, r"\.[^./]*$", "").alias("_place")
    )


def extension_edges(files: DataFrame, pattern_from: str, pattern_to: str, rel: str) -> DataFrame:
    """Edges between files of two globs that lie at the same place below them, such as a page and what it documents.

    The place is the path below the fixed folders of the glob, without its
    extension: `docs/**` and `src/**` pair `docs/a/b.md` with `src/a/b.go`.
    """
    left = _placed(files, pattern_from, "from")
    return left.join(_placed(files, pattern_to, "to"), "_place").where(F.col("from") != F.col("to")).select("from", "to", F.lit(rel).alias("rel"))


# Relations and their inverse.
INVERSE_RELATIONS = {"imports": "imported_by", "documented_by": "documents", "tested_by": "tests", "tests": "tested_by"}


def inverse_edges(edges: DataFrame, relations: dict[str, str] = INVERSE_RELATIONS) -> DataFrame:
    """The inverse of every edge whose relation has one."""
    inverse = None
    for rel, other in relations.items():
        inverse = F.when(F.col("rel") == rel, other) if inverse is None else inverse.when(F.col("rel") == rel, other)
    return edges.select(
        F.col("to").alias("from"), F.col("from").alias("to"), inverse.alias("rel")
    ).where(F.col("rel").isNotNull())
