"""Lookups, counts and set differences over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depscope.functions.paths import is_external
from depscope.schemas import EDGE_COLUMNS

# Spellings of the reverse direction.
REVERSE_WORDS = ("reverse", "incoming", "in", "backward")


def lookup_column(direction: str) -> str:
    """The edge end a path is compared with."""
    return "to" if direction.lower() in REVERSE_WORDS else "from"


def related(edges: DataFrame, path: str, rel: str | None = None, direction: str = "forward") -> DataFrame:
    """Edges that leave a path, or that reach it."""
    found = edges.where(F.col(lookup_column(direction)) == path)
    return (found if rel is None else found.where(F.col("rel") == rel)).select(*EDGE_COLUMNS)


def related_many(edges: DataFrame, paths: DataFrame, rel: str | None = None, direction: str = "forward") -> DataFrame:
    """`related` for a table of paths: one row per (path, edge)."""
    kept = edges if rel is None else edges.where(F.col("rel") == rel)
    wanted = paths.select("path").distinct()
    return wanted.join(kept, F.col("path") == F.col(lookup_column(direction))).select("path", *EDGE_COLUMNS)


def in_graph(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths with a flag that says whether they occur at either end of an edge."""
    wanted = paths.select("path").distinct()
    ends = edges.select(F.explode(F.array("from", "to")).alias("path"))
    # Only ends that are asked for are de-duplicated, after a semi join.
    present = ends.join(wanted, "path", "left_semi").distinct().withColumn("_seen", F.lit(True))
    return wanted.join(present, "path", "left").select("path", F.coalesce("_seen", F.lit(False)).alias("in_graph"))


def _spellings(path):
    """A path as given, then without leading `/home/`, `./` and `/`."""
    without = lambda lead, regex: F.when(path.startswith(lead), F.regexp_replace(path, regex, "")).otherwise(path)
    return F.array(path, without("/home/", "^(?:/home/)+"), without("./", r"^(?:\./)+"), F.ltrim(path, F.lit("/")))


def related_with_fallback(
    edges: DataFrame, requests: DataFrame, rel: str | None = None, direction: str = "forward"
) -> DataFrame:
    """Edges of the first spelling of each requested path that has any."""
    kept = edges if rel is None else edges.where(F.col("rel") == rel)
    column = lookup_column(direction)
    spelled = (
        requests.select("path").distinct()
        .select("path", F.posexplode(_spellings(F.col("path"))).alias("pos", "name"))
        .groupBy("path", "name").agg(F.min("pos").alias("pos"))
    )
    known = kept.select(F.col(column).alias("name")).join(spelled, "name", "left_semi").distinct()
    # One winner per request, chosen before its edges are fetched: no window over a hub.
    winner = (
        spelled.join(known, "name").groupBy("path")
        .agg(F.min(F.struct("pos", "name")).alias("best")).select("path", F.col("best.name").alias("name"))
    )
    return winner.join(kept, F.col("name") == F.col(column)).select("path", *EDGE_COLUMNS)


def external_edges(edges: DataFrame) -> DataFrame:
    return edges.where(is_external(F.col("to")))


def local_targets(edges: DataFrame, exclude_external: bool = False) -> DataFrame:
    kept = edges.where(~is_external(F.col("to"))) if exclude_external else edges
    return kept.select("to").distinct()


def count_edges(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("total_edges"))


def group_by_dependency(edges: DataFrame) -> DataFrame:
    """Edge count per (target, relation), largest first."""
    return edges.groupBy("to", "rel").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "to", "rel")


def distinct_files(edges: DataFrame) -> DataFrame:
    """The distinct sources and the distinct targets as (side, path) rows."""
    ends = F.explode(F.array(
        F.struct(F.lit("from").alias("side"), F.col("from").alias("path")),
        F.struct(F.lit("to").alias("side"), F.col("to").alias("path")),
    ))
    return edges.select(ends.alias("end")).select("end.side", "end.path").distinct()


def top_dependencies(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent targets; equal counts in name order."""
    return edges.groupBy("to").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "to").limit(k)


def graph_stats(edges: DataFrame, k: int = 10) -> DataFrame:
    """One row: edge, source and target counts, and the top targets as an array."""
    # One count per target gives the total, the distinct targets and the top at once.
    targets = edges.groupBy("to").agg(F.count("*").alias("cnt"))
    totals = targets.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_edges"), F.count("to").alias("unique_dependencies"))
    files = edges.select("from").distinct().agg(F.count("from").alias("unique_files")).scalar()
    # The list holds at most k entries and is read as a scalar.
    top = targets.orderBy(F.desc("cnt"), "to").limit(k).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), "to", "cnt"))),
            lambda e: F.struct(e["to"].alias("to"), e["cnt"].alias("cnt")),
        ).alias("top")
    ).scalar()
    totals = totals.select("total_edges", files.alias("unique_files"), "unique_dependencies")
    return totals.select("*", top.alias("top_dependencies"))


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with `change` = added or removed."""
    return edge_changes(old.select(*EDGE_COLUMNS, F.lit(1).alias("_side")).unionByName(new.select(*EDGE_COLUMNS, F.lit(2).alias("_side"))))


def edge_changes(tagged: DataFrame) -> DataFrame:
    """Edges with `change` = added or removed, of old ones with `_side` = 1 and new ones with 2."""
    # One shuffle tells both directions: 1 = only old, 2 = only new, 3 = both.
    sides = tagged.groupBy(*EDGE_COLUMNS).agg(F.bit_or("_side").alias("_sides"))
    change = F.when(F.col("_sides") == 1, "removed").when(F.col("_sides") == 2, "added")
    return sides.select(*EDGE_COLUMNS, change.alias("change")).where("change is not null")
