"""Source trees as tables.

Spark's own file sources leave out names that start with `_` or `.`, which would
lose `__init__.py`. The tree is listed here folder level by folder level: each
level is one job over the folders found by the level before, so a tree is walked
by all executors. Contents are read in a second pass that is spread over the
cluster by path, whatever the shape of the tree.

Names that are gone, forbidden or unreachable over links are left out, and counted in the accumulator
`skipped` if one is given (a task that is repeated counts again). Any other failure of a store, and a
root that is missing or forbidden, is raised, so that Spark repeats the task and the job fails rather
than lose files.
"""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from depscope import scratch
from depscope.functions.paths import extension

# Folder names and file extensions that a scan leaves out or keeps.
DISCOVER_SKIPPED = ("target", "node_modules", "vendor", "__pycache__", ".venv")
DISCOVER_EXTENSIONS = ("go", "py", "ts", "tsx", "rs", "js", "jsx", "java", "c", "cpp", "cc", "cxx", "hpp", "hxx", "rb")
CLASSIFY_SKIPPED = (".git", "target", "node_modules", ".vfs", "vendor", "__pycache__")
CLASSIFY_EXTENSIONS = (
    "rs", "py", "go", "js", "jsx", "ts", "tsx", "java", "c", "cpp", "cc", "cxx", "h", "hpp", "hxx", "rb",
)


@dataclass(frozen=True)
class ScanProfile:
    """Which names a scan visits and which files it keeps."""

    skipped: tuple[str, ...]
    skip_hidden: bool
    extensions: tuple[str, ...] | None
    ignore_case: bool
    follow_links: bool

    def visits(self, name: str) -> bool:
        return name not in self.skipped and not (self.skip_hidden and name.startswith("."))

    def keeps(self, name: str) -> bool:
        if self.extensions is None:
            return True
        stem, dot, ext = name.rpartition(".")
        return bool(dot and stem) and (ext.lower() if self.ignore_case else ext) in self.extensions


PROFILES = {
    "discover": ScanProfile(DISCOVER_SKIPPED, True, DISCOVER_EXTENSIONS, False, False),
    "classify": ScanProfile(CLASSIFY_SKIPPED, False, CLASSIFY_EXTENSIONS, True, True),
    "all": ScanProfile((), False, None, False, False),
}

# Entries of a folder that leave a task at once.
LISTED_ROWS = 10_000

_ENTRY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("is_dir", T.BooleanType()),
    T.StructField("length", T.LongType()), T.StructField("mtime", T.TimestampType()),
])


def _file_system(root: str):
    """(file system, path inside it) of a root address, from inside a task."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return None, root
    if root.startswith("file:"):
        return None, "/" + root[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(root)


# Failures that lie in the name itself, so that trying again finds nothing.
_LEFT_OUT = (errno.ENOENT, errno.ENOTDIR, errno.EACCES, errno.EPERM, errno.ELOOP, errno.ENAMETOOLONG)


def _leave_out(error: OSError, skipped) -> None:
    """Count a name that is left out; other failures are raised."""
    if error.errno not in _LEFT_OUT and not isinstance(error, (FileNotFoundError, PermissionError)):
        raise error
    if skipped is not None:
        skipped.add(1)


def _list_folder(root: str, folder: str, profile: ScanProfile, skipped=None) -> list[tuple]:
    from pyarrow import fs

    system, base = _file_system(root)
    full = f"{base.rstrip('/')}/{folder}" if folder else base
    found = []
    if system is None:
        try:
            with os.scandir(full) as entries:
                for entry in entries:
                    if not profile.visits(entry.name):
                        continue
                    try:
                        is_dir = entry.is_dir(follow_symlinks=profile.follow_links)
                        if not is_dir and not entry.is_file(follow_symlinks=profile.follow_links):
                            continue
                        info = entry.stat(follow_symlinks=profile.follow_links)
                    except OSError as error:
                        _leave_out(error, skipped)
                        continue
                    found.append((entry.name, is_dir, info.st_size, info.st_mtime))
        except OSError as error:
            if not folder:
                raise
            # Entries read before a failure are not half a folder: it is left out as a whole.
            _leave_out(error, skipped)
            return []
    else:
        for info in system.get_file_info(fs.FileSelector(full, allow_not_found=bool(folder))):
            if profile.visits(info.base_name):
                modified = info.mtime.timestamp() if info.mtime else 0.0
                found.append((info.base_name, info.type == fs.FileType.Directory, info.size or 0, modified))
    prefix = f"{folder}/" if folder else ""
    return [
        (prefix + name, is_dir, size, datetime.fromtimestamp(mtime, timezone.utc).replace(tzinfo=None))
        for name, is_dir, size, mtime in found if is_dir or profile.keeps(name)
    ]


def _listed(root: str, folders, profile: ScanProfile, skipped=None) -> Iterator[pd.DataFrame]:
    """The entries of folders in frames of bounded size."""
    for folder in folders:
        rows = _list_folder(root, folder, profile, skipped)
        for at in range(0, len(rows), LISTED_ROWS):
            frame = pd.DataFrame(rows[at : at + LISTED_ROWS], columns=_ENTRY.names).astype({"name": object})
            frame["mtime"] = pd.to_datetime(frame["mtime"])
            yield frame


def _folder_of(prefix: str) -> str:
    """The deepest folder that holds every name with a prefix; the root where the prefix is no plain path."""
    folder = prefix.rpartition("/")[0]
    return "" if any(part in ("", ".", "..") for part in folder.split("/")) else folder


def list_files(spark: SparkSession, root: str, profile: str | ScanProfile = "discover", skipped=None, prefix: str = "") -> DataFrame:
    """(path, length, mtime) of the kept files below a folder; contents are not read.

    With a prefix, only files whose path starts with it: the listing begins at the folder it names and enters no other.
    """
    rules = PROFILES[profile] if isinstance(profile, str) else profile
    run = scratch.new_folder(spark, "listing")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _listed(root, batch["name"], rules, skipped)

    found = spark.read.schema(T.StructType(_ENTRY.fields + [T.StructField("level", T.IntegerType())]))
    folders, level = spark.createDataFrame([(_folder_of(prefix),)], "name string"), 0
    inside = F.concat(F.col("name"), F.lit("/"))
    while True:
        folders.select("name").mapInPandas(expand, _ENTRY).write.parquet(f"{run}/level={level}")
        below = found.option("basePath", run).parquet(run).where((F.col("level") == level) & F.col("is_dir"))
        if prefix:
            below = below.where(inside.startswith(prefix) | F.lit(prefix).startswith(inside))
        count = below.count()
        if not count:
            break
        # A given number: adaptive execution would merge rows this small into one task.
        folders, level = below.repartition(min(count, 4 * spark.sparkContext.defaultParallelism), "name"), level + 1
    return (
        found.option("basePath", run).parquet(run).where(~F.col("is_dir") & F.col("name").startswith(prefix))
        .select(F.col("name").alias("path"), "length", "mtime")
    )


def read_contents(
    listing: DataFrame, root: str, batch_bytes: int = 8 * 1024 * 1024, task_bytes: int = 128 * 1024 * 1024, skipped=None
) -> DataFrame:
    """Add the bytes of each listed file; files that are gone or forbidden are left out.

    The number of tasks follows from the listed sizes, as the listing itself is small.
    """
    files, size = listing.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(files, max(size // task_bytes + 1, listing.sparkSession.sparkContext.defaultParallelism)))
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("length", T.LongType()),
        T.StructField("mtime", T.TimestampType()), T.StructField("data", T.BinaryType()),
    ])

    kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("data", pa.binary())])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(root)
        for batch in batches:
            rows, size = [], 0
            for path, length, mtime in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "mtime"))):
                full = f"{base.rstrip('/')}/{path}"
                try:
                    if system is None:
                        with open(full, "rb") as handle:
                            data = handle.read()
                    else:
                        with system.open_input_stream(full) as handle:
                            data = handle.read()
                except OSError as error:
                    _leave_out(error, skipped)
                    continue
                rows.append((path, length, mtime, data))
                size += len(data)
                if size >= batch_bytes:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return listing.repartition(tasks, "path").mapInArrow(load, schema)


def scan_files(spark: SparkSession, root: str, profile: str | ScanProfile = "discover", skipped=None) -> DataFrame:
    """(path, content, length, mtime) of the readable UTF-8 files below a folder."""
    return (
        read_contents(list_files(spark, root, profile, skipped), root, skipped=skipped)
        .where(F.is_valid_utf8(F.col("data").cast("string")))
        .select("path", F.col("data").cast("string").alias("content"), "length", "mtime")
    )


def select_scanned(paths: DataFrame, profile: str = "discover") -> DataFrame:
    """The rows of a file catalog that a scan with this profile would keep."""
    rules = PROFILES[profile]
    segments = F.split("path", "/")
    name_skipped = lambda s: s.isin(*rules.skipped) | (s.startswith(".") if rules.skip_hidden else F.lit(False))
    kept = ~F.exists(segments, name_skipped) if rules.skipped or rules.skip_hidden else F.lit(True)
    if rules.extensions is not None:
        ext = extension(F.col("path"))
        kept = kept & (F.lower(ext) if rules.ignore_case else ext).isin(*rules.extensions)
    return paths.where(kept)


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(key, length, mtime) of every object whose key starts with a prefix."""
    return list_files(spark, root, "all", prefix=prefix).withColumnRenamed("path", "key")
