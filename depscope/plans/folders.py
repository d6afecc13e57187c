"""Totals of all folders of a tree at once, from the deepest level up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depscope import scratch

_TOTALS = "folder string, files long, bytes long, children long"


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def folder_totals(files: DataFrame) -> DataFrame:
    """(folder, files, bytes, children) for every folder of files (path, length); the top is the empty name.

    `files` and `bytes` count everything below a folder, `children` its own files and folders. Repeated rows of a file
    count as often as they occur, a null length is 0, and a null path is left out; leading slashes are
    ignored; no files give no rows.

    A folder's totals are those of its own files and of its folders, so each level adds up the level below: a file is
    shuffled once and a folder twice, however deep it lies, and a folder with very many entries is summed before the
    shuffle. There is one job per level of the deepest path.
    """
    spark = files.sparkSession
    run = scratch.new_folder(spark, "folders")
    own = (
        files.where("path IS NOT NULL").groupBy(_parent(F.ltrim(F.col("path"), F.lit("/"))).alias("folder"))
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("children"))
        .withColumn("depth", F.when(F.col("folder") == "", 0).otherwise(F.regexp_count("folder", F.lit("/")) + 1))
    )
    # A folder per level, so that a level reads its own rows only.
    own.write.partitionBy("depth").parquet(f"{run}/own")
    own = spark.read.schema(_TOTALS + ", depth int").parquet(f"{run}/own")
    deepest = own.agg(F.max("depth")).first()[0]
    below = spark.createDataFrame([], _TOTALS)
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = own.where(F.col("depth") == depth).drop("depth").unionByName(below)
        level = level.groupBy("folder").agg(*[F.sum(c).alias(c) for c in ("files", "bytes", "children")])
        level = scratch.store(level, f"{run}/totals/level={depth}")
        below = level.select(_parent(F.col("folder")).alias("folder"), "files", "bytes", F.lit(1).cast("long").alias("children"))
    if deepest is None:
        return below
    return spark.read.schema(_TOTALS).parquet(f"{run}/totals").select("folder", "files", "bytes", "children")
