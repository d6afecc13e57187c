"""An edge table laid out for lookups by one end.

Edges are kept in folders by a hash of the key and sorted by it inside. A lookup
of few keys then reads only the folders those keys fall in (partition pruning at
run time) and, inside them, only the matching row groups. The rebalance hint
splits a folder that holds a very frequent key into several files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depscope import scratch
from depscope.schemas import EDGE_COLUMNS


@dataclass(frozen=True)
class EdgeLayout:
    path: str
    key: str
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("`from` string, `to` string, rel string, bucket int").parquet(self.path)

    def bucket_of(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")


def write_layout(edges: DataFrame, path: str, key: str, buckets: int | None = None) -> EdgeLayout:
    """Write edges for lookups by `from` or by `to`."""
    if key not in ("from", "to"):
        raise ValueError("an edge layout is by 'from' or by 'to'")
    count = buckets or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layout = EdgeLayout(path, key, count)
    (
        edges.select(*EDGE_COLUMNS).withColumn("bucket", layout.bucket_of(F.col(key)))
        .hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
        .write.mode("overwrite").partitionBy("bucket").parquet(path)
    )
    return layout


def lookup(layout: EdgeLayout, spark: SparkSession, names: DataFrame, column: str = "path") -> DataFrame:
    """Edges whose key is one of the given names, reading only the folders needed.

    The names are stored first: their size on disk lets Spark broadcast them if they
    are few, and their filter makes it prune folders by them. Both are off otherwise.
    """
    wanted = names.select(F.col(column).alias("_name")).distinct().withColumn("_bucket", layout.bucket_of(F.col("_name")))
    wanted = scratch.materialize(wanted, "names").where(F.col("_bucket") >= 0)
    edges = layout.read(spark)
    return edges.join(
        wanted, (edges["bucket"] == wanted["_bucket"]) & (edges[layout.key] == wanted["_name"]), "left_semi"
    ).select(*EDGE_COLUMNS)
