"""Edge tables: line-delimited JSON for exchange, Parquet for analysis."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from depscope import scratch
from depscope.schemas import EDGE, EDGE_COLUMNS


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a JSON-lines file or folder; blank and broken lines are left out."""
    return (
        spark.read.schema(EDGE).option("mode", "DROPMALFORMED").json(path)
        .dropna(subset=EDGE_COLUMNS)
    )


def write_edges(edges: DataFrame, path: str, max_edges_per_file: int | None = None) -> None:
    """Append edges as JSON lines, split into files of a given length if asked."""
    writer = edges.select(*EDGE_COLUMNS).write.mode("append")
    if max_edges_per_file:
        writer = writer.option("maxRecordsPerFile", max_edges_per_file)
    writer.json(path)


def new_edges(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming edges, each once, that are not in an existing table."""
    return incoming.select(*EDGE_COLUMNS).dropDuplicates().join(
        existing.select(*EDGE_COLUMNS).distinct(), EDGE_COLUMNS, "left_anti"
    )


def _or_empty(spark: SparkSession, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EDGE)


def append_edges_dedup(edges: DataFrame, path: str) -> int:
    """Append the edges a JSON-lines target does not hold yet; returns how many."""
    spark = edges.sparkSession
    existing = _or_empty(spark, lambda: read_edges(spark, path))
    return _append(new_edges(edges, existing), lambda added: write_edges(added, path))


def upsert_edges(edges: DataFrame, path: str) -> int:
    """Insert-or-ignore into a Parquet edge table; returns how many were new."""
    spark = edges.sparkSession
    existing = _or_empty(spark, lambda: read_edge_table(spark, path))
    return _append(new_edges(edges, existing), lambda added: added.write.mode("append").parquet(path))


def read_edge_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE).parquet(path)


def _append(added: DataFrame, write) -> int:
    # The difference is stored first: what is counted is exactly what is appended,
    # and the target is not read while it is written.
    folder = scratch.new_folder(added.sparkSession, "append")
    stored = scratch.store(added, folder)
    count = stored.count()
    if count:
        write(stored)
    scratch.discard(added.sparkSession, folder)
    return count


def nodes(edges: DataFrame) -> DataFrame:
    """Every name that occurs at either end of an edge, once."""
    return edges.select(F.explode(F.array("from", "to")).alias("path")).distinct()
