"""Tables written to the shared checkpoint folder.

Iterative operators cut their lineage by writing each step as Parquet. A step
then survives the loss of any executor, and its real file size is what Spark
compares with the broadcast threshold.
"""

from __future__ import annotations

import contextlib
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else one below the session's warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """Size of a stored table on disk."""
    store, path = _at(spark, folder)
    return store.getContentSummary(path).getLength()


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder this module named, once nothing reads it any more."""
    if not folder.startswith(shared_root(spark) + "/"):
        raise ValueError(f"{folder} is not inside the shared checkpoint folder")
    store, path = _at(spark, folder)
    store.delete(path, True)
    made = _made.get(spark.sparkContext.applicationId, [])
    if folder in made:
        made.remove(folder)


def clear(spark: SparkSession) -> None:
    """Remove every folder this application still has here; frames read from them end with this."""
    for folder in list(_made.get(spark.sparkContext.applicationId, [])):
        discard(spark, folder)


@contextlib.contextmanager
def kept_for(spark: SparkSession) -> Iterator[SparkSession]:
    """Within the block results may rest in the shared folder; what was added there goes when it ends."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    before = set(made)
    try:
        yield spark
    finally:
        for folder in [x for x in made if x not in before]:
            discard(spark, folder)


def store(df: DataFrame, folder: str) -> DataFrame:
    """Write a frame once and read it back."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def materialize(df: DataFrame, label: str) -> DataFrame:
    folder = new_folder(df.sparkSession, label)
    out = store(df, folder)
    _folders[out] = folder
    return out


def drop(*stored: DataFrame) -> None:
    """Remove what frames made by `materialize` hold, once no later step reads them; other frames are left alone."""
    for df in stored:
        folder = _folders.pop(df, None)
        if folder:
            discard(df.sparkSession, folder)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: its cleaner acts when the driver collects what referred to them.

    Long chains of jobs otherwise keep all of them until the driver happens to need memory.
    """
    spark._jvm.System.gc()
