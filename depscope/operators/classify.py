"""Role and stability of source files from their path and text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from depscope.operators.extract import CLASSIFIED_LANGUAGES, language_of

# Marks in a lower-cased path.
TEST_CONTAINS = ("_test.", ".test.", "_spec.", "/test/", "/tests/", "\\test\\", "__test__")
TEST_STARTS = ("test_",)
TEST_ENDS = ("_test.go", "test.java", "tests.java", "_spec.rb")
ENTRYPOINT_ENDS = (
    "main.rs", "main.go", "main.py", "main.c", "main.cpp", "main.js", "main.ts", "main.rb",
    "index.js", "index.ts", "__main__.py",
)
EXAMPLE_CONTAINS = ("/example", "/examples/", "\\examples\\")
EXAMPLE_STARTS = ("examples/", "example/")
CONFIG_ENDS = (".toml", ".yaml", ".yml", ".json", ".lock", ".cfg", ".ini", ".env")
SCRIPT_CONTAINS = ("/scripts/", "\\scripts\\")
# Language names as they appear in a reason.
LANGUAGE_NAMES = {
    "rust": "Rust", "python": "Python", "go": "Go", "javascript": "JavaScript", "typescript": "TypeScript",
    "java": "Java", "c": "C", "cpp": "Cpp", "ruby": "Ruby",
}

# Text patterns (the subset of syntax Java and RE2 share).
RUST_MAIN = r"(?m)^[ \t]*fn main\("
RUST_PUBLIC = r"(?m)^[ \t]*pub (?:async )?fn\b"
GO_MAIN = r"(?m)^func main\(\)"
GO_EXPORTED = r"(?m)^[ \t]*(?:func|type) [ \t]*\p{Lu}"
C_MAIN = r"(?:int|void) main\([^;{}]*\{"
RUBY_SHEBANG = r"(?m)^[ \t]*#!/usr/bin/env ruby"


def _contains(text: Column, marks) -> Column:
    return reduce(or_, [text.contains(m) for m in marks])


def _starts(text: Column, marks) -> Column:
    return reduce(or_, [text.startswith(m) for m in marks])


def _ends(text: Column, marks) -> Column:
    return reduce(or_, [text.endswith(m) for m in marks])


def is_test_path(lower_path: Column) -> Column:
    return _contains(lower_path, TEST_CONTAINS) | _starts(lower_path, TEST_STARTS) | _ends(lower_path, TEST_ENDS)


def has_entrypoint(language: Column, text: Column) -> Column:
    """Whether a text starts a program in its language."""
    return (
        F.when(language == "rust", text.rlike(RUST_MAIN))
        .when(language == "python", _contains(text, ('if __name__ == "__main__"', "if __name__ == '__main__'")))
        .when(language == "go", text.rlike(GO_MAIN))
        .when(language.isin("javascript", "typescript"), _contains(text, ("module.exports", "export default", "exports.")))
        .when(language == "java", text.contains("public static void main("))
        .when(language.isin("c", "cpp"), text.rlike(C_MAIN))
        .when(language == "ruby", text.rlike(RUBY_SHEBANG))
        .otherwise(F.lit(False))
    )


def has_public_api(language: Column, text: Column) -> Column:
    """Whether a text offers something to other files in its language."""
    return (
        F.when(language == "rust", F.regexp_count(text, F.lit(RUST_PUBLIC)) >= 3)
        .when(language == "python", _contains(text, ("__all__", "def ", "class ")))
        .when(language == "go", text.rlike(GO_EXPORTED))
        .when(language.isin("javascript", "typescript"), _contains(text, ("export ", "module.exports")))
        .when(language == "java", _contains(text, ("public class", "public interface")))
        .when(language.isin("c", "cpp"), F.regexp_count(text, F.lit(r"\);")) >= 2)
        .when(language == "ruby", text.contains("def ") & _contains(text, ("module ", "class ")))
        .otherwise(F.lit(False))
    )


def _labels(role: str, status, reason: Column) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    return F.struct(F.lit(role).alias("role"), status.alias("status"), reason.alias("reason"))


def classification(lower: Column, language: Column, text: Column) -> Column:
    """Struct (role, status, reason) from a lower-cased path; the first step that applies decides."""
    in_source = lower.contains("/src/") & ~_contains(lower, ("/test", "/example"))
    library_status = F.when(in_source, "stable").otherwise("beta")
    names = F.create_map(*[F.lit(text) for pair in LANGUAGE_NAMES.items() for text in pair])
    named = F.try_element_at(names, language)

    def reason(words: str) -> Column:
        return F.concat(F.lit(words + " "), named)

    return (
        F.when(is_test_path(lower), _labels("test", "beta", reason("filename matches test pattern for")))
        .when(_ends(lower, ENTRYPOINT_ENDS), _labels("entrypoint", "stable", reason("filename convention:")))
        .when(has_entrypoint(language, text), _labels("entrypoint", "stable", reason("contains entrypoint pattern for")))
        .when(has_public_api(language, text), _labels("library", library_status, reason("has public API surface for")))
        .when(
            _contains(lower, EXAMPLE_CONTAINS) | _starts(lower, EXAMPLE_STARTS),
            _labels("example", "stable", F.lit("in examples directory")),
        )
        .when(_ends(lower, CONFIG_ENDS), _labels("config", "stable", F.lit("configuration file")))
        .when(_contains(lower, SCRIPT_CONTAINS), _labels("script", "beta", F.lit("in scripts directory")))
        .otherwise(_labels("unknown", "unknown", F.lit("no classification pattern matched")))
    )


def classify_files(files: DataFrame) -> DataFrame:
    """(path, role, status, reason) of every file in a known language."""
    known = files.select(
        "path", "content", F.lower("path").alias("_lower"),
        language_of(F.col("path"), CLASSIFIED_LANGUAGES, ignore_case=True).alias("_language"),
    ).where("_language is not null")
    # Null content stands for a file that could not be read.
    labels = F.when(F.col("content").isNotNull(), classification(F.col("_lower"), F.col("_language"), F.col("content")))
    return known.select("path", labels.alias("c")).select("path", "c.role", "c.status", "c.reason")


def role_summary(classified: DataFrame) -> DataFrame:
    """Files per role, largest first."""
    return (
        classified.where(F.col("role").isNotNull()).groupBy("role").agg(F.count("*").alias("files"))
        .orderBy(F.desc("files"), "role")
    )


def classify_totals(classified: DataFrame) -> DataFrame:
    """One row: files scanned, files classified, files in error."""
    return classified.agg(
        F.count("*").alias("files"), F.count("role").alias("classified"),
        F.count_if(F.col("role").isNull()).alias("errors"),
    )


def classification_metadata(classified: DataFrame, version) -> DataFrame:
    """Metadata rows (path, key, value, version) that record role and status."""
    pairs = F.explode(F.map_from_arrays(F.array(F.lit("role"), F.lit("status")), F.array("role", "status")))
    return classified.where(F.col("role").isNotNull()).select("path", pairs).select(
        "path", "key", "value", F.lit(version).cast("bigint").alias("version")
    )
