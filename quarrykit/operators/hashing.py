"""Hashes of contents: from a table that holds them, or of files that are opened by path and read in pieces.

Both kinds give two tables of hashes for given files (idx, path, size): ``quick`` of the first 16 KiB and ``whole`` of
all, with the number of bytes read and an error text where a content cannot be read. Only hashes leave a task.
"""

from __future__ import annotations

import hashlib
import math
import os
import stat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.operators.numbering import numbered, scratch

PREFIX = 16 * 1024
#: What is read of a file at a time, and about how much of all files a task reads.
PIECE, TASK_BYTES = 128 * 1024, 1 << 29
SCHEMA = "idx long, hash string, bytes long, error string"


def prefix_hash(content: Column) -> Column:
    """SHA-256 of the number of bytes read and these bytes, 16 KiB at most."""
    head = F.substring(content, 1, PREFIX)
    length = F.unhex(F.lpad(F.hex(F.length(head).cast("long")), 16, "0"))
    return F.sha2(F.concat(length, head), 256)


class TableContents:
    """Contents in a table (idx, content). Each is hashed where it lies; one that is null, or missing, has no row.

    Which are hashed whole is a join with the wanted ids, which are written first so that Spark knows their size:
    few are sent to the contents. A content has to fit into a row, so files of some size belong to ``PathContents``.
    """

    def __init__(self, table: DataFrame):
        self.table = table.select("idx", F.col("content").cast("binary").alias("content")).filter("content is not null")

    def quick(self, files: DataFrame) -> DataFrame:
        n = F.least(F.length("content"), F.lit(PREFIX)).cast("long")
        return self.table.select("idx", prefix_hash(F.col("content")).alias("hash"), n.alias("bytes"), F.lit(None).cast("string").alias("error"))

    def whole(self, files: DataFrame) -> DataFrame:
        at = scratch(files.sparkSession, "wanted")
        files.select("idx").distinct().write.parquet(at)
        wanted = files.sparkSession.read.parquet(at)
        return self.table.join(wanted, "idx", "left_semi").select("idx", F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("bytes"), F.lit(None).cast("string").alias("error"))


def opened(path: str):
    """A regular file, open for reading; a pipe or a device is an error, and opening it does not wait."""
    handle = os.open(path, os.O_RDONLY | getattr(os, "O_NONBLOCK", 0))
    if not stat.S_ISREG(os.fstat(handle).st_mode):
        os.close(handle)
        raise OSError("not a regular file")
    return os.fdopen(handle, "rb", buffering=0)


def hash_file(path: str, whole: bool, buffer: bytearray) -> tuple[str, int]:
    """The hash of a file, or of its start, and how much was read; no more than ``buffer`` is in memory."""
    view, n = memoryview(buffer), 0
    with opened(path) as f:
        if whole:
            made = hashlib.sha256()
            while got := f.readinto(view):
                made.update(view[:got])
                n += got
            return made.hexdigest(), n
        while n < PREFIX and (got := f.readinto(view[n:PREFIX])):
            n += got
    return hashlib.sha256(n.to_bytes(8, "big") + view[:n]).hexdigest(), n


class PathContents:
    """Files that every task can open by their path. They are dealt out so that all tasks have about as much to read."""

    def __init__(self, task_bytes: int = TASK_BYTES, piece: int = PIECE):
        self.task_bytes, self.piece = task_bytes, max(piece, PREFIX)

    def quick(self, files: DataFrame) -> DataFrame:
        return self._hashed(files, False)

    def whole(self, files: DataFrame) -> DataFrame:
        return self._hashed(files, True)

    def dealt(self, files: DataFrame, whole: bool) -> DataFrame:
        """(idx, path, size), the largest first to one task each, then back from the last task to the first, and so on."""
        rows = files.select("idx", "path", "size")
        cost = F.coalesce("size", F.lit(0)) if whole else F.least(F.coalesce("size", F.lit(0)), F.lit(PREFIX))
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum(cost), F.lit(0))).first()
        spare = files.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(n, max(math.ceil(total / self.task_bytes), spare)))
        ranked = numbered(rows, [F.desc_nulls_last("size"), F.asc("idx"), F.asc("path")], "no", "long")
        turn, place = F.floor((F.col("no") - 1) / tasks), (F.col("no") - 1) % tasks
        task = F.when(turn % 2 == 0, place).otherwise(tasks - 1 - place)
        return ranked.repartitionById(tasks, task.cast("int")).drop("no")

    def _hashed(self, files: DataFrame, whole: bool) -> DataFrame:
        piece = self.piece

        def run(batches):
            buffer = bytearray(piece)
            for batch in batches:
                out = []
                for path in batch["path"].to_pylist():
                    try:
                        out.append((*hash_file(path, whole, buffer), None))
                    except (OSError, ValueError) as e:  # a path with a null character is a ValueError
                        out.append((None, 0, f"{path}: {getattr(e, 'strerror', None) or e}"))
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch["idx"], *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string())))], names=["idx", "hash", "bytes", "error"])

        return self.dealt(files, whole).mapInArrow(run, SCHEMA)


def contents_of(source: DataFrame | TableContents | PathContents) -> TableContents | PathContents:
    """A table (idx, content) as contents; what is that already stays as it is."""
    return TableContents(source) if isinstance(source, DataFrame) else source
