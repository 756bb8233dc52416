"""Tables that survive a crash: every write is a folder of its own, and a list names the whole ones.

``path`` holds a folder ``data-...`` for each version and ``versions``, a table with a row for each version that is
whole. A write fills a new folder first and adds its row last, by appending a file of one row, which Spark's committer
moves into place as a whole. So a write that fails half-way leaves the version before as the newest, a table can be
rewritten from itself, and who reads an older version keeps its files until ``vacuum``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST = T.StructType().add("version", "long").add("folder", "string").add("writer", "string").add("batch", "long")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table; files that are no Parquet, or broken, count as empty (Spark warns of each)."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class Versions:
    """The versions of one table. Writers take turns; of two that write at once, one version is taken as the newest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def listed(self) -> DataFrame:
        """(version, folder, writer, batch) of the versions that are whole."""
        return read_or_empty(self.spark, f"{self.path}/versions", LIST).filter("folder is not null")

    def newest(self) -> Row | None:
        return self.listed().orderBy(F.desc("version"), F.desc("folder")).first()

    def read(self, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
        """The newest version, or the one asked for; without any an empty table of ``schema``, or an error."""
        row = self.newest() if version is None else self.listed().filter(F.col("version") == version).orderBy(F.desc("folder")).first()
        if row is None and schema is None:
            raise FileNotFoundError(f"{self.path}: no version")
        if row is None:
            return self.spark.createDataFrame([], schema)
        at = f"{self.path}/{row.folder}"
        return self.spark.read.parquet(at) if schema is None else read_or_empty(self.spark, at, schema)

    def write(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """``df`` as the next version; its number."""
        row = self.newest()
        version = (row.version if row else 0) + 1
        folder = f"data-{version:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(version, folder, writer, batch)], LIST).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return version

    def wrote(self, writer: str, batch: int) -> bool:
        """Whether this batch of a writer is in a version already."""
        return bool(self.listed().filter((F.col("writer") == writer) & (F.col("batch") == batch)).limit(1).count())

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the data of all but the newest ``keep`` versions, and what failed writes have left; the folders' names.

        Not while somebody writes: an unfinished version looks like one that failed.
        """
        kept = {r.folder for r in self.listed().orderBy(F.desc("version"), F.desc("folder")).limit(keep).collect()}
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(sc._jsc.hadoopConfiguration())
        gone = []
        for status in files.listStatus(at) if files.exists(at) else []:
            name = status.getPath().getName()
            if name.startswith("data-") and name not in kept:
                files.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)
