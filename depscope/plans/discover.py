"""From source files to an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depscope.operators.associate import flag_external, test_associations
from depscope.operators.extract import extract_imports, language_of


def discover(files: DataFrame, mounts: DataFrame | None = None) -> DataFrame:
    """Import and test edges of a file table; targets in other mounted repositories are flagged."""
    edges = extract_imports(files).unionByName(test_associations(files.select("path")))
    return edges if mounts is None else flag_external(edges, mounts)


def discover_summary(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, distinct sources of imports, distinct languages of the files."""
    languages = files.select(F.count_distinct(language_of(F.col("path"))).alias("n")).scalar()
    return edges.agg(
        F.count("*").alias("edges"),
        F.count_distinct(F.when(F.col("rel") == "imports", F.col("from"))).alias("sources"),
    ).select("edges", "sources", languages.alias("languages"))
