"""Small catalog tables and the index of stored blobs."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from depscope.operators.metadata import content_hash
from depscope.schemas import BLOB, MOUNT


def read_mounts(spark: SparkSession, path: str) -> DataFrame:
    """The mount table; a missing or empty one has no rows."""
    try:
        return spark.read.schema(MOUNT).option("mode", "DROPMALFORMED").json(path).dropna(subset=["kind", "at"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MOUNT)


def write_mounts(mounts: DataFrame, path: str) -> None:
    mounts.select(*MOUNT.names).write.mode("overwrite").json(path)


def blob_rows(blobs: DataFrame, uploaded_at, content: str = "content") -> DataFrame:
    """Index rows (path, hash, backend, uploaded_at) of written objects."""
    return blobs.select(
        "path", content_hash(F.col(content)).alias("hash"), F.lit("s3").alias("backend"),
        F.lit(uploaded_at).cast("bigint").alias("uploaded_at"),
    )


def append_blob_index(rows: DataFrame, path: str) -> None:
    rows.select(*BLOB.names).write.mode("append").json(path)


def read_blob_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOB).option("mode", "DROPMALFORMED").json(path).dropna(subset=["path", "hash"])


def query_inventory(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """User SQL over named inventory tables, joins across them included.

    The names hold in this text only: the frames get names of their own while it is
    analysed, so users of one session do not overwrite each other's views. Semicolons at the
    end are left out. The text runs as it is, so its order holds; one that begins with
    WITH becomes a subquery, where an order holds only with a limit.
    """
    sql = re.sub(r"(?:\s*;)+\s*$", "", sql)
    if not tables:
        return spark.sql(sql, args or {})
    views = {name: f"_{name}_{uuid.uuid4().hex}" for name in tables}
    for name, table in tables.items():
        table.createOrReplaceTempView(views[name])
    try:
        named = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        if re.match(r"(?is)(?:\s|--[^\n]*\n|/\*.*?\*/)*with\b", sql):
            sql = f"SELECT * FROM (\n{sql}\n)"
        return spark.sql(f"WITH {named}\n{sql}", args or {})
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
