"""Stored objects as a stream of index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depscope.operators.metadata import content_hash


def blob_index_rows(objects: DataFrame) -> DataFrame:
    """(path, hash, backend, uploaded_at) of written objects (path, content, modificationTime)."""
    return objects.select(
        "path", content_hash(F.col("content")).alias("hash"), F.lit("s3").alias("backend"),
        F.unix_seconds("modificationTime").alias("uploaded_at"),
    )


def index_blobs(objects: DataFrame, index: str, checkpoint: str, **trigger):
    """Append an index row for each object of a stream, exactly once."""
    return (
        blob_index_rows(objects).writeStream.format("json").option("path", index)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )
