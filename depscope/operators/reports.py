"""Reports over files and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depscope.functions.globs import matches_any
from depscope.functions.paths import first_segment, is_external
from depscope.operators.associate import source_of_test
from depscope.functions.paths import file_name

# Marks of generated files.
GENERATED_HEADERS = ("DO NOT EDIT", "auto-generated", "Code generated by")
GENERATED_PATHS = ("*.pb.go", "*.gen.go", "*.generated.*")


def untested_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Source files without a `tests` edge; test files themselves are left out."""
    sources = files.where(source_of_test(file_name(F.col("path"))).isNull()).select("path")
    tested = edges.where(F.col("rel") == "tests").select(F.col("from").alias("path")).distinct()
    return sources.join(tested, "path", "left_anti")


def module_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files, edges and test coverage per top folder. Edges count for the module they start in."""
    out = edges.groupBy(F.col("from").alias("path")).agg(
        F.count("*").alias("_edges"), F.max(F.when(F.col("rel") == "tests", 1)).alias("_tested")
    )
    return (
        files.select("path", first_segment(F.col("path")).alias("module"))
        .join(out, "path", "left")
        .groupBy("module").agg(
            F.count("*").alias("files"),
            F.coalesce(F.sum("_edges"), F.lit(0)).cast("bigint").alias("edges_count"),
            F.round(F.count("_tested") * 100.0 / F.count("*"), 1).alias("test_coverage_pct"),
        )
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Number of edge ends at each node."""
    return edges.select(F.explode(F.array("from", "to")).alias("path")).groupBy("path").agg(F.count("*").alias("degree"))


def most_connected(edges: DataFrame, k: int = 1) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "path").limit(k)


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files at neither end of any edge."""
    # Distinct before the join: a hub is one row per map task, and the join reuses its shuffle.
    ends = edges.select(F.explode(F.array("from", "to")).alias("path")).distinct()
    return files.select("path").join(ends, "path", "left_anti")


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("cnt"))


def infer_features(files: DataFrame, overrides: DataFrame | None = None, pattern: str = r"(?:^|/)src/([^/]+)/") -> DataFrame:
    """Feature of a file from its folder; an override (path, feature) wins. Null without either."""
    folder = F.regexp_extract("path", pattern, 1)
    inferred = files.select("path", F.when(folder != "", F.concat(folder, F.lit("-module"))).alias("inferred"))
    if overrides is None:
        return inferred.withColumnRenamed("inferred", "feature")
    chosen = overrides.groupBy("path").agg(F.max("feature").alias("override"))
    return inferred.join(chosen, "path", "left").select("path", F.coalesce("override", "inferred").alias("feature"))


def is_generated(path: Column, content: Column) -> Column:
    """A generated file says so in its text, or by its name."""
    marked = F.lit(False)
    for header in GENERATED_HEADERS:
        marked = marked | content.contains(header)
    return matches_any(path, GENERATED_PATHS) | F.coalesce(marked, F.lit(False))


def detect_generated(files: DataFrame) -> DataFrame:
    return files.where(is_generated(F.col("path"), F.col("content"))).select("path")


def loc_metrics(files: DataFrame) -> DataFrame:
    """Lines of each text; a last line without a line break counts."""
    text = F.col("content")
    breaks = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")
    open_end = F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
    return files.select("path", (breaks + open_end).alias("loc"))


def relation_entries(edges: DataFrame) -> DataFrame:
    """(path, entry): `rel:target` of each relation of a file, once; external targets stand as they are."""
    rows = edges.select(F.col("from").alias("path"), "to", "rel").distinct()
    entry = F.when(is_external(F.col("to")), F.col("to")).otherwise(F.concat("rel", F.lit(":"), "to"))
    return rows.select("path", entry.alias("entry")).distinct()


def impact_entries(dependents: DataFrame) -> DataFrame:
    """(path, entry): `direct:a` or `indirect:b` of each root from `impact_many` rows.

    A dependent under another top folder than the root counts as external.
    """
    rows = dependents.select(F.col("root").alias("path"), F.col("path").alias("name"), "depth")
    kind = (
        F.when(first_segment(F.col("name")) != first_segment(F.col("path")), "external")
        .when(F.col("depth") == 1, "direct").otherwise("indirect")
    )
    return rows.select("path", F.concat(kind, F.lit(":"), F.col("name")).alias("entry")).distinct()


def one_text(entries: DataFrame, separator: str = "|") -> DataFrame:
    """(path, text): the entries of each path in order, joined. The text of a hub is one value, as long as the hub is large."""
    return entries.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("entry")), separator).alias("text"))


def render_relations(edges: DataFrame) -> DataFrame:
    """`rel:target|rel:target` texts of each file; `relation_entries` has them as rows."""
    return one_text(relation_entries(edges))


def render_impact(dependents: DataFrame) -> DataFrame:
    """`direct:a|indirect:b` texts of each root; `impact_entries` has them as rows."""
    return one_text(impact_entries(dependents))
