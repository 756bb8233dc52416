"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors see.

    Where the session names none, a local master gets a temporary folder; a cluster gets an error, as a
    machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="quarrykit-checkpoint-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that no lost executor restarts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(texts: DataFrame) -> DataFrame:
    """``texts``, from now on handed to Python in batches of a thousand rows where the session has Spark's ten thousand.

    Ten thousand long texts at a time are some hundred megabytes for an executor with several workers.
    """
    conf, key = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, "1000")
    return texts


def tidy(run):
    """``run`` for mapInArrow, whose worker gives free memory back when the task ends: workers live on and are many."""

    def tidied(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def slices(batches, rows: int = 256):
    """Arrow batches in pieces, so that a task holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def splitmix(x):
    """A bijective mix of numpy uint64 values (the finaliser of SplitMix64)."""
    import numpy as np

    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
