"""Files in the shared folder, written and read by executors.

Executors can be lost and tasks run twice, also with their rows in another order, so every attempt writes files of
its own names, and the rows that it gives name them: an index never points into another attempt's file. Files that
no index names are left over from attempts that didn't count; ``sweep`` removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

PART_BYTES = 32 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path such as file:///x, hdfs://n/x or s3://b/x, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:/") else f"file://{uri}")


def put(uri: str, chunks) -> None:
    """Write the byte chunks to a file, whole or not at all."""
    files, path = opened(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None) as out:
        for c in chunks:
            out.write(c)
    files.move(part, path)


def new_run() -> str:
    """A beginning of file names for one write, so that several can share a folder."""
    return uuid.uuid4().hex[:12]


def attempt_name(run: str) -> str:
    """Of the running task: a beginning of file names that no other attempt of it has."""
    return f"{run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"


def remove(uri: str) -> None:
    files, path = opened(uri)
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_file(path)


def delete(folder: str, names: DataFrame, suffix: str) -> None:
    """Delete the files of these names (one column), in tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("name").to_pylist():
                remove(f"{folder}/{name}{suffix}")
            yield b

    names.toDF("name").mapInArrow(each, "name string").count()


def sweep(folder: str, run: str, kept: DataFrame, suffix: str) -> None:
    """Delete the files of a run that aren't in kept (names, one column). The driver lists names only."""
    files, path = opened(folder)
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return
    there = [(f.base_name.removesuffix(suffix),) for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.startswith(run) and f.base_name.endswith(suffix)]
    kept = kept.toDF("name").distinct()
    if kept.count() < len(there):
        delete(folder, kept.sparkSession.createDataFrame(there, "name string").join(kept, "name", "left_anti"), suffix)


def parts_for(total_bytes: int | None) -> int:
    """Into how many partitions rows go that make their tasks read this many bytes of files."""
    return max(1, -(-int(total_bytes or 0) // PART_BYTES))
