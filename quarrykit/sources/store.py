"""What is kept between commands: the index, the usage records, and the cache of hashes, each a table of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.operators.usage import saved
from quarrykit.sources.versions import Versions

USAGE = T.StructType().add("key", "string").add("path", "string").add("score", "double").add("count", "long").add("last", "long")
CACHE = T.StructType().add("key", "string").add("size", "long").add("mtime", "long").add("full", "string")


def write_index(files: DataFrame, path: str) -> int:
    return Versions(files.sparkSession, path).write(files)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The newest index; a row whose parent is not there is an error."""
    files = Versions(spark, path).read()
    lost = files.filter("parent is not null").join(files.select(F.col("path").alias("_p")), F.col("parent") == F.col("_p"), "left_anti")
    if lost.limit(1).count():
        raise ValueError(f"{path}: an entry's parent is missing")
    return files


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage records; none if there is no table yet, or a broken one."""
    return Versions(spark, path).read(USAGE)


def write_usage(state: DataFrame, path: str, now: int, half_life_days: float = 30.0) -> int:
    """What saving keeps of ``state``, which may come from ``path`` itself."""
    return Versions(state.sparkSession, path).write(saved(state, now, half_life_days).select(*USAGE.fieldNames()))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, path).read(CACHE)


def merged_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """One entry for each key: the new one where there is one."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return both.groupBy("key").agg(F.max_by(F.struct("size", "mtime", "full"), F.struct("age", "mtime")).alias("v")).select("key", "v.*")


def write_cache(old: DataFrame, new: DataFrame, path: str) -> None:
    """Adds what a run has learned, and writes nothing where that is nothing; ``old`` may come from ``path`` itself."""
    if new.limit(1).count():
        Versions(new.sparkSession, path).write(merged_cache(old, new))


def write_cleanup_plan(plan: DataFrame, path: str) -> None:
    """The keep/clean plan as CSV for spreadsheets: byte order mark, CRLF, quotes where needed.

    A folder of files in order, each with its own head; a small plan is one file.
    """
    named = plan.orderBy("group_no", (F.col("action") == "남김").desc(), "path").select(
        F.col("action").alias("\ufeff조치"), F.col("path").alias("경로"), F.col("size").alias("크기(바이트)"), F.col("group_no").alias("묶음"), F.col("why").alias("근거")
    )
    named.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def _text(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def _pairs(items: Column, show) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, show), ", "), F.lit("]"))


def paper_json(papers: DataFrame) -> DataFrame:
    """(round, json): each paper as a JSON object, keys in order; short items and sub-items are pairs."""
    subs = lambda i: _pairs(i["subs"], lambda x: F.concat(F.lit("["), _text(x["k"]), F.lit(", "), _text(x["v"]), F.lit("]")))
    item = lambda i: F.concat(F.lit('{"no": '), i["no"].cast("string"), F.lit(', "spec": '), _text(i["spec"]), F.lit(', "stem": '), _text(i["stem"]), F.lit(', "subs": '), subs(i), F.lit("}"))
    block = lambda b: F.concat(F.lit('{"gyosi": '), b["gyosi"].cast("string"), F.lit(', "items": '), _pairs(b["items"], item), F.lit("}"))
    short = lambda i: F.concat(F.lit("["), i["no"].cast("string"), F.lit(", "), _text(i["text"]), F.lit("]"))
    parts = {"essay": _pairs(F.col("essay"), block), "gyosi_estimated": F.col("gyosi_estimated").cast("string"), "period1": _pairs(F.col("period1"), short), "round": F.col("round").cast("string"), "source": _text(F.col("source")), "year": _text(F.col("year"))}
    joined = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items()))
    return papers.filter(F.col("period1").isNotNull()).select("round", F.concat(F.lit("{"), joined, F.lit("}")).alias("json"))


def write_questions(papers: DataFrame, path: str) -> None:
    """All papers (one row for each round) as one JSON object ``{"papers": {"110": ...}}``, rounds in order as text.

    A line for each paper, in a folder of files whose lines in order are the object; few papers are one file.
    """
    rows = papers_lines(paper_json(papers))
    rows.orderBy("place", "key").select("value").write.mode("overwrite").text(path)


def papers_lines(rows: DataFrame) -> DataFrame:
    keyed = rows.select(F.col("round").cast("string").alias("key"), "json")
    first = keyed.agg(F.min("key").alias("_first"))
    comma = F.when(F.col("key") == F.col("_first"), F.lit("")).otherwise(F.lit(", "))
    body = keyed.join(F.broadcast(first), F.col("_first").isNotNull()).select(F.lit(1).alias("place"), "key", F.concat(comma, F.lit('"'), "key", F.lit('": '), "json").alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "", '{"papers": {'), (2, "", "}}")], "place int, key string, value string")
    return ends.unionByName(body)
