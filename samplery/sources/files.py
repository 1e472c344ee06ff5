"""Parts of files that tasks open themselves: listed files, members of tars, ranges of rows of equal length.

What is to be read is a table of paths, offsets and lengths; tasks seek to their own rows, so a large file is read by
many tasks, never held whole, and files that no row names are not opened. Paths are those of a folder that all
executors share, or URIs of a store that Arrow's file systems know.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplery.shipping import map_arrow

#: Bytes that a task holds before it gives them out, and bytes of rows that are read at once.
HELD, PART = 16 << 20, 4 << 20


def opened(path: str) -> pa.NativeFile:
    """A file for reading from any place of it."""
    if path.startswith("file:") or "://" in path:
        system, own = fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)
    else:
        system, own = fs.LocalFileSystem(), path
    return system.open_input_file(own)


def size_of(path: str) -> int:
    with opened(path) as f:
        return f.size()


def read_parts(parts: DataFrame, missing: str = "error") -> DataFrame:
    """``parts`` (``path``, ``start``, ``length``; a null length: to the end) with ``content``. Files that are not there are an error, or their rows are left out if ``missing`` is 'skip'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, contents, held = [], [], 0
            for k, (path, start, length) in enumerate(zip(*(b.column(c).to_pylist() for c in ("path", "start", "length")), strict=True)):
                try:
                    with opened(path) as f:
                        f.seek(start or 0)
                        contents.append(f.read(length))
                except (FileNotFoundError, IsADirectoryError):
                    if missing != "skip":
                        raise
                    continue
                rows.append(k)
                held += len(contents[-1])
                if held >= HELD:
                    yield _with(b, rows, contents)
                    rows, contents, held = [], [], 0
            if rows:
                yield _with(b, rows, contents)

    return map_arrow(parts, run, T.StructType([*parts.schema.fields, T.StructField("content", T.BinaryType())]))


def _with(batch: pa.RecordBatch, rows: list[int], contents: list[bytes]) -> pa.RecordBatch:
    own = batch.take(pa.array(rows, pa.int32()))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(contents, pa.binary())], [*own.schema.names, "content"])


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over tasks, a few for each core: by a stated number, since rows so short would else be put into one task again."""
    session = rows.sparkSession
    return rows.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *by)


def tar_members(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``tar`` (place in ``paths``), ``member`` (place in the tar), ``name``, ``path``, ``start`` and ``length`` of regular members: only their headers are read, a tar by one task."""
    tars = spread(spark.createDataFrame(list(enumerate(paths)), "tar int, path string"), "tar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tar, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with opened(path) as f, tarfile.open(fileobj=f, mode="r:") as t:
                    found = [(tar, n, m.name, path, m.offset_data, m.size) for n, m in enumerate(x for x in t if x.isfile())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["tar", "member", "name", "path", "start", "length"])

    return map_arrow(tars, run, "tar int, member long, name string, path string, start long, length long")


def read_members(members: DataFrame) -> DataFrame:
    """Members with their ``content``, dealt over tasks by themselves."""
    return read_parts(spread(members, "tar", "member"))


def read_rows(spark: SparkSession, paths: Sequence[str], row: int, skip: int = 0) -> DataFrame:
    """``path``, ``n`` (from 0) and ``row`` of files that are rows of ``row`` bytes after ``skip`` bytes; what is left at the end is not read. Ranges of rows go to tasks of their own."""
    per = max(1, PART // row)
    ranges = []
    for path in paths:
        count = max(0, size_of(path) - skip) // row
        ranges += [(path, at, min(per, count - at)) for at in range(0, count, per)]
    own = spark.createDataFrame(ranges, "path string, first long, rows long")
    own = spread(own.withColumns({"start": F.col("first") * row + skip, "length": F.col("rows") * row}), "path", "first")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda i: F.substring(F.col("content"), (i * row + 1).cast("int"), F.lit(row)))
    return read_parts(own).select("path", "first", F.posexplode(cut).alias("at", "row")).select("path", (F.col("first") + F.col("at")).alias("n"), "row")
