"""Searching an index: filter, join with usage, order, limit, and tags for duplicates among what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarrykit.functions.text import decayed, human, normalize_key
from quarrykit.operators import dup
from quarrykit.operators.numbering import numbered
from quarrykit.plans.compile import predicate
from quarrykit.plans.query import Query, parse


def order_by(sort: str) -> list[Column]:
    """Sort keys; ties that the key leaves go by path or by idx."""
    orders = {
        "freq": [F.desc("score"), F.asc("path"), F.asc("idx")],
        "name": [F.lower("name").asc(), F.asc("idx")],
        "size": [F.desc_nulls_first("size"), F.asc("idx")],
        "date": [F.desc("mtime"), F.asc("idx")],
    }
    key = {"frecency": "freq"}.get(sort, sort)
    if key not in orders:
        raise ValueError(f"unknown order: {sort}")
    return orders[key]


def with_usage(files: DataFrame, usage: DataFrame, now: int, half_life_days: float = 30.0) -> DataFrame:
    """Files with score and count, 0 where there is no record."""
    state = usage.select(F.col("key").alias("_key"), decayed(F.col("score"), F.lit(now) - F.col("last"), half_life_days).alias("_score"), F.col("count").alias("_count"))
    joined = files.join(state, normalize_key(F.col("path")) == F.col("_key"), "left")
    return joined.withColumns({"score": F.coalesce("_score", F.lit(0.0)), "count": F.coalesce("_count", F.lit(0)).cast("long")}).drop("_key", "_score", "_count")


def hits(files: DataFrame, query: Query | str, usage: DataFrame, content: DataFrame | None = None, now: int = 0, half_life_days: float = 30.0) -> DataFrame:
    """All matches (roots never match). ``dup:`` asks for duplicates among the rows that the other terms leave.

    Usage joins only what the terms that do not ask for it leave.
    """
    query = parse(query) if isinstance(query, str) else query
    if query.needs_dup and content is None:
        raise ValueError("dup: needs the files' content")
    counted, plain = query.without_dup().parted("runcount")
    rows = files.filter(F.col("parent").isNotNull()).filter(predicate(plain))
    rows = with_usage(rows, usage, now, half_life_days).filter(predicate(counted))
    if not query.needs_dup:
        return rows
    twins = dup.twins(dup.matched(rows, content)).select(F.col("idx").alias("_twin")).distinct()
    marked = rows.join(twins, F.col("idx") == F.col("_twin"), "left").withColumn("is_dup", F.col("_twin").isNotNull()).drop("_twin")
    return marked.filter(predicate(query.parted("dup")[0]))


def search(files: DataFrame, query: Query | str, usage: DataFrame, content: DataFrame | None = None, sort: str = "freq", limit: int = 50, now: int = 0, half_life_days: float = 30.0, counted: Observation | None = None) -> DataFrame:
    """The first ``limit`` matches (0: all) in order.

    ``counted`` learns, from the job that reads the result, how many there are before the limit: its ``total``.
    """
    found = hits(files, query, usage, content, now, half_life_days)
    if counted is not None:
        found = found.observe(counted, F.count(F.lit(1)).alias("total"))
    out = found.orderBy(*order_by(sort))
    return out.limit(limit) if limit else out


def tagged(shown: DataFrame, content: DataFrame) -> DataFrame:
    """What is shown, with the number of its duplicate group among what is shown: a twin that the limit has cut
    leaves no tag."""
    found = dup.matched(shown, content)
    tags = dup.members(found, dup.groups(found)).select(F.col("idx").alias("_idx"), F.col("group_no").alias("dup_tag"))
    return shown.join(tags, F.col("idx") == F.col("_idx"), "left").drop("_idx")


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def rendered(shown: DataFrame) -> DataFrame:
    """One line for each row, as the command line shows it; ``dup_tag`` is used where it is there, and ``no`` (from
    ``results``) numbers the lines of a dialogue."""
    freq = F.when(F.col("count") > 0, F.format_string("%4d회 %6.2f", "count", "score")).otherwise(F.format_string("%4s   %6s", F.lit("-"), F.lit("-")))
    size = F.when(F.col("is_dir"), F.lit("<DIR>")).otherwise(human(F.col("size")))
    tag = F.when(F.col("dup_tag").isNotNull(), F.format_string(" [중복 %d]", "dup_tag")).otherwise(F.lit("")) if "dup_tag" in shown.columns else F.lit("")
    number = F.format_string("%4d. ", "no") if "no" in shown.columns else F.lit("")
    return shown.select(F.concat(number, freq, F.lit("  "), F.lpad(size, 9, " "), F.lit("  "), F.col("path"), tag).alias("line"))


def results(found: DataFrame, sort: str = "freq", limit: int = 50) -> DataFrame:
    """The first ``limit`` matches (0: all) in order, numbered from 1 as ``no``."""
    first = found.orderBy(*order_by(sort)).limit(limit) if limit else found
    return numbered(first, order_by(sort), "no")


def footer(found: DataFrame, limit: int = 50) -> DataFrame:
    """The line below a list that the limit has cut: how many there are and how many are shown; else no row."""
    n = total(found).filter(F.col("total") > limit) if limit else total(found).limit(0)
    return n.select(F.format_string("... 전체 %d 건 중 %d 건", "total", F.lit(limit)).alias("line"))


def dup_candidates(files: DataFrame, query: str, usage: DataFrame, now: int = 0) -> DataFrame:
    """What ``dup`` looks at: matches that are files. A ``dup:`` term finds nothing here, as no set is known yet."""
    found = hits_without_set(files, parse(query), usage, now)
    return found.filter(~F.col("is_dir"))


def hits_without_set(files: DataFrame, query: Query, usage: DataFrame, now: int) -> DataFrame:
    rows = with_usage(files.filter(F.col("parent").isNotNull()), usage, now).withColumn("is_dup", F.lit(False))
    return rows.filter(predicate(query)).drop("is_dup")
