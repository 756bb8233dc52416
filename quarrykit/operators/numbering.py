"""Tables between steps, and consecutive numbers in a global order without passing all rows through one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Without one, a local master gets a temporary folder; a cluster gets an error, as executors would not see each
    other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="quarrykit-checkpoint-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, by: list[Column], name: str, kind: str = "int") -> DataFrame:
    """``df`` with ``name``, 1 to n in the order ``by`` (which must be total to be definite).

    Rows are dealt into ranges; each range numbers its own rows, from where the ranges before it end.
    """
    ranges = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part").orderBy(*by)
    rows = ranges.withColumn("_own", F.row_number().over(own)).join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    return rows.select(*df.columns, (F.col("_start") + F.col("_own")).cast(kind).alias(name))
