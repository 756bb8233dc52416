"""Papers structured as they arrive: new files in a folder are processed once each, and one row a round is kept.

Of several papers of a round the one that arrived last wins (of equal times, the one with the larger name). A batch is
an upsert into a table of versions that names the batch, so a batch that runs again after a crash changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrykit.operators import papers
from quarrykit.sources.versions import Versions


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text, arrived) of text files that appear below a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return raw.select(F.regexp_extract("path", "([^/]*)$", 1).alias("source"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("arrived"))


def newest(rows: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``: the one that arrived last."""
    latest = F.max_by(F.struct(*rows.columns), F.struct("arrived", "source"))
    return rows.groupBy(F.col(key).alias("_key")).agg(latest.alias("_row")).select("_row.*")


def upsert(batch: DataFrame, batch_id: int, out: str, writer: str) -> None:
    """Adds a batch (source, text, arrived) to the tables ``out``/papers, a row a round, and ``out``/failures, a row a source."""
    spark = batch.sparkSession
    kept, failed = Versions(spark, f"{out}/papers"), Versions(spark, f"{out}/failures")
    if kept.wrote(writer, batch_id) and failed.wrote(writer, batch_id):
        return
    # a name that comes twice in a batch is one paper: the later one
    own = newest(batch.select("source", "text", "arrived"), "source")
    made = papers.structured(own, ("arrived",)).select("round", "year", "source", "gyosi_estimated", "period1", "essay", "arrived", "error")
    good = made.filter("error is null").drop("error")
    bad = made.filter("error is not null").select("source", F.col("error").alias("reason"), "arrived")
    for table, rows, key in ((kept, good, "round"), (failed, bad, "source")):
        if not table.wrote(writer, batch_id):
            table.write(newest(table.read(rows.schema).unionByName(rows), key), writer, batch_id)


def structure(stream: DataFrame, out: str, checkpoint: str, writer: str = "papers") -> StreamingQuery:
    """Keeps the tables below ``out`` up to date; what is there already is taken in one go, then the query ends."""
    step = lambda batch, batch_id: upsert(batch, batch_id, out, writer)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
