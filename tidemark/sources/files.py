"""Files of a folder or bucket: what is there, and single objects put, read and deleted. Any file system that pyarrow or the
local machine knows is reached by its URI; executors do the work side by side."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpointed

ENTRY = "path string, kind string, size bigint, modified timestamp, target string"


def file_system(location: str):
    """The file system of a URI, or the local one, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(location if "://" in location else f"file://{os.path.abspath(location.removeprefix('file:'))}")


def _local(location: str) -> bool:
    return "://" not in location or location.startswith("file://")


def entries_of(location: str, folder: str) -> Iterator[tuple]:
    """Entries right in a folder, by path below the location: files, folders, and links with their targets. Links are not
    followed; sockets, pipes and devices are passed over."""
    system, root = file_system(location)
    full = f"{root.rstrip('/')}/{folder}".rstrip("/")
    below = lambda name: f"{folder}/{name}".lstrip("/")
    if _local(location):
        with os.scandir(full or "/") as found:
            for e in found:
                about = e.stat(follow_symlinks=False)
                at = datetime.fromtimestamp(about.st_mtime, UTC)
                if e.is_symlink():
                    yield below(e.name), "link", None, at, os.readlink(e.path)
                elif stat.S_ISDIR(about.st_mode):
                    yield below(e.name), "folder", None, at, None
                elif stat.S_ISREG(about.st_mode):
                    yield below(e.name), "file", about.st_size, at, None
        return
    from pyarrow import fs

    for f in system.get_file_info(fs.FileSelector(full)):
        kind = "folder" if f.type == fs.FileType.Directory else "file"
        yield below(f.base_name), kind, f.size if kind == "file" else None, f.mtime, None


def listed(spark: SparkSession, location: str) -> DataFrame:
    """path, kind, size, modified, target of everything below a location, paths without a slash in front.

    Folders are listed level by level, those of a level side by side; a level is checkpointed, as the next needs it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
        for batch in batches:
            rows = [r for folder in batch.column(0).to_pylist() for r in entries_of(location, folder)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "kind", "size", "modified", "target"])

    levels = []
    folders = spark.createDataFrame([("",)], "path string")
    while not levels or not folders.isEmpty():
        levels.append(checkpointed(folders.repartition("path").mapInArrow(read, ENTRY)))
        folders = levels[-1].filter("kind = 'folder'").select("path")
    return reduce(DataFrame.unionByName, levels)


def by_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Files whose path starts with a prefix, in the order of an object listing."""
    return entries.filter((F.col("kind") == "file") & F.startswith("path", F.lit(prefix)))


def _checked(key: str | None) -> str:
    if not key or key.startswith("/") or any(p in ("", ".", "..") for p in key.split("/")):
        raise ValueError(f"{key!r} is no key")
    return key


def put(objects: DataFrame, location: str, replace: bool = False) -> DataFrame:
    """key, size, outcome of objects given as (key, content): written, there, or what went wrong.

    An object is written under another name first and takes its own when it is whole, so a task that runs again or dies
    leaves no half of one; without `replace` one that is there stays. A null content is an empty object.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = file_system(location)
        for batch in batches:
            rows: list[tuple] = []
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() or b""
                try:
                    path = f"{root.rstrip('/')}/{_checked(key)}"
                    if not replace and system.get_file_info(path).type != fs.FileType.NotFound:
                        rows.append((key, len(data), "there"))
                        continue
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    part = f"{path}.{os.getpid()}.part"
                    with system.open_output_stream(part) as f:
                        f.write(data)
                    system.move(part, path)
                    rows.append((key, len(data), "written"))
                except (ValueError, OSError) as e:
                    rows.append((key, len(data), str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "size", "outcome"])

    return objects.select("key", F.col("content").cast("binary").alias("content")).mapInArrow(write, "key string, size bigint, outcome string")


def get(keys: DataFrame, location: str) -> DataFrame:
    """key, content of objects; of one that is not there the content is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(location)
        for batch in batches:
            for key in batch.column(0).to_pylist():  # one object a batch, as objects may be large
                try:
                    with system.open_input_stream(f"{root.rstrip('/')}/{_checked(key)}", compression=None) as f:
                        data = f.read()
                except (ValueError, OSError):
                    data = None
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([data], pa.binary())], names=["key", "content"])

    return keys.select("key").mapInArrow(read, "key string, content binary")


def delete(keys: DataFrame, location: str) -> DataFrame:
    """key, outcome of objects to delete: deleted or missing; deleting twice is no error."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(location)
        for batch in batches:
            outcome = []
            for key in batch.column(0).to_pylist():
                try:
                    system.delete_file(f"{root.rstrip('/')}/{_checked(key)}")
                    outcome.append("deleted")
                except (ValueError, FileNotFoundError):
                    outcome.append("missing")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outcome, pa.string())], names=["key", "outcome"])

    return keys.select("key").mapInArrow(drop, "key string, outcome string")
